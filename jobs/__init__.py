"""Runnable jobs: ``python -m jobs.<name> --config jobs/<name>.yaml --input ... --output ...``."""
