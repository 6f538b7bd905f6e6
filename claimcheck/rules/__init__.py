"""Rule data: cue packs, task policies, category suffixes and bucket names."""
