"""Domain operators: segmentation, label traces, segmentation metrics."""
