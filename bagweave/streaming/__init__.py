"""Structured Streaming: replays whose state is kept between micro-batches."""
