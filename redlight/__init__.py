"""Traffic-enforcement analytics on Spark: detections, plate reads, tracks, indicators."""
