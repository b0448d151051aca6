"""Binary formats of signals and their tags, made block by block."""
