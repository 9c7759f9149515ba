"""The pipeline: its steps, their order, and runs of them."""
