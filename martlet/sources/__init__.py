from martlet.sources.dump import convert_dump, read_dump
from martlet.sources.jdbc import read_database
from martlet.sources.star import Star, star_from_parquet, star_from_retail
from martlet.sources.tables import (
    list_tables,
    preview,
    read_tables,
    register_views,
    run_query,
)
from martlet.sources.writers import write_bucketed, write_table

__all__ = [
    "Star",
    "convert_dump",
    "list_tables",
    "preview",
    "read_database",
    "read_dump",
    "read_tables",
    "register_views",
    "run_query",
    "star_from_parquet",
    "star_from_retail",
    "write_bucketed",
    "write_table",
]
