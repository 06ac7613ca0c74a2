from quillmart.sources.star import MissingColumnsError, StarTables, conform, load_star

__all__ = ["MissingColumnsError", "StarTables", "conform", "load_star"]
