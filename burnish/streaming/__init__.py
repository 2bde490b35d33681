"""Running row-wise cleaning steps on a stream."""
