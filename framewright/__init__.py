"""Timeline analytics on Spark: sampling, detection, tracking, segmentation and cue merging of frame streams."""
