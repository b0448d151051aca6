"""Small fixed dimensions: (id, target loudness, ceiling)."""

# Public loudness targets of delivery platforms, and presets for the override join.
PLATFORMS = [("spotify", -14.0, -1.0), ("apple", -16.0, -1.0), ("youtube", -14.0, -1.0), ("tidal", -14.0, -1.0)]
PRESETS = [("preset0", -14.0, -1.0), ("preset1", -11.5, -1.0), ("preset2", -9.0, -0.8), ("preset3", -16.0, -1.5), ("preset4", -23.0, -2.0)]
