"""cuemill: a PySpark-native engine for caption tracks, cue text and corpus preparation."""
