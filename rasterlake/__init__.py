"""Spark-native evaluation, selection and manifest operators for segmentation rasters."""
