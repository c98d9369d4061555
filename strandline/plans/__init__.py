"""Plans that keep state between jobs: stores, checkpoints, backfill, replay and the engine."""
