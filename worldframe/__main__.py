"""python -m worldframe IN OUT: import every map file under IN and write the world's tables as Parquet under OUT."""

import sys

from pyspark.sql import SparkSession

from worldframe.operators import mesh
from worldframe.plans.lineage import cut
from worldframe.sinks.svg import save_world
from worldframe.sources import mapfile


def main(source: str, target: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    files = mapfile.read(spark, source)
    tables = {"world_header": mapfile.header(files), "world_settings": mapfile.settings(files), "coordinates": mapfile.coordinates(files)}
    grid, pack, errors = mapfile.with_mesh(files, cut(mesh.regenerated(mapfile.mesh_inputs(files))))
    tables |= {"grid_cells": grid, "pack_cells": pack, "import_errors": errors, "cell_routes": mapfile.route_map(files)}
    tables |= {"biomes": mapfile.biomes(files), "notes": mapfile.notes(files), "namebases": mapfile.namebases(files)}
    tables |= {name: mapfile.catalog(files, name) for name in mapfile.CATALOGS}
    save_world(tables, target)


if __name__ == "__main__":
    main(*sys.argv[1:3])
