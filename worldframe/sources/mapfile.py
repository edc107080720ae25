"""Slotted map files: text slots parted by CR LF, plain or gzip, as DataFrames. Column expressions except for gunzip."""

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Slots of the per-cell columns and their conversions.
GRID = {7: ("height", "u8"), 8: ("precipitation", "u16"), 9: ("feature_id", "u16"), 10: ("water_type", "i8"), 11: ("temperature", "i8")}
PACK = {
    16: ("biome", "u8"), 17: ("burg", "u16"), 18: ("confluence", "u16"), 19: ("culture", "u16"), 20: ("flux", "u16"), 21: ("population", "f32"), 22: ("river", "u16"),
    24: ("score", "u16"), 25: ("state", "u16"), 26: ("religion", "u16"), 27: ("province", "u16"), 40: ("good", "u16"), 44: ("market", "u16"),
}
HEADER = ("version", "license", "date", "seed", "graph_width", "graph_height", "map_id")
# Closed domains of the catalogs, in lower case; what is in none becomes the last of its list.
PEOPLE = ("river", "naval", "nomadic", "hunting", "highland", "generic")
PEOPLE_OR_LAKE = ("lake", *PEOPLE)
FORMS = ("monarchy", "republic", "theocracy", "union", "anarchy")
LAND = ("continent", "isle", "lake_island", "island")
LAKES = ("freshwater", "salt", "dry", "sinkhole", "lava")
# JSON catalogs: slot, whether element 0 is a placeholder, and the fields as "name key kind".
_CATALOGS = {
    "features": (12, True, "id i long; kind type feature; is_land land flag; touches_border border flag; cell_count cells long; first_cell firstCell long; group group string; name name string; perimeter vertices ids; shoreline shoreline ids; lake_height height float"),
    "cultures": (13, True, "id i long; name name string; namebase_id base long; shield shield string; center_cell center long; code code string; color color string; expansionism expansionism float; kind type culture; origins origins ids; locked lock flag; removed removed flag"),
    "states": (14, True, "id i long; name name string; form form form; full_name fullName string; color color string; center_cell center long; culture culture long; kind type people; expansionism expansionism float; area_px area float; burg_count burgs long; cell_count cells long; rural_pop rural float; urban_pop urban float; neighbors neighbors ids; provinces provinces ids; capital capital long; diplomacy diplomacy string; campaigns campaigns string; military military string; coat_of_arms coa string; removed removed flag"),
    "burgs": (15, True, "id i long; name name string; cell cell long; x x float; y y float; culture culture long; state state long; feature feature long; population population float; kind type people; is_capital capital flag; port port flag; has_citadel citadel flag; has_plaza plaza flag; has_shanty shanty flag; has_temple temple flag; has_walls walls flag; locked lock flag; removed removed flag"),
    "religions": (29, False, "id i long; name name string; color color string; kind type string; expansion expansion string; center_cell center long; origins origins ids; removed removed flag"),
    "provinces": (30, True, "id i long; name name string; state state long; capital burg long; color color string; center_cell center long; burgs burgs ids; locked lock flag; removed removed flag"),
    "rivers": (32, False, "id i long; name name string; source_cell source long; mouth_cell mouth long; parent_river parent long; basin_id basin long; discharge_m3s discharge float; length_km length float; width_km width float; width_factor widthFactor float; source_width_km sourceWidth float; type_name type string; cells cells path"),
    "markers": (35, False, "id i long; icon icon string; kind type string; x x float; y y float; cell cell long"),
    "routes": (37, False, "id i long; group group string; feature feature long; points points string; length length float"),
    "zones": (38, False, "id i long; name name string; color color string; cells cells ids; kind type string"),
    "ice": (39, False, "id i long; kind type string; points points string; cell cellId long"),
    "measurers": (46, False, "kind type string; points points string"),
}
CATALOGS = {name: (at, skip, {n: (key, kind) for n, key, kind in (f.split() for f in fields.split(";"))}) for name, (at, skip, fields) in _CATALOGS.items()}
UNSET_CELL = 4294967295


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, slots: the slots of every map file under a path. Plain if a bar is in the first ten bytes, else gzip; text is UTF-8."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            text = [(c if b"|" in c[:10] else gzip.decompress(c)).decode("utf-8") for c in part["content"]]
            yield pd.DataFrame({"path": part["path"], "text": text})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string").select("path", slots(F.col("text")).alias("slots"))


def slots(text: Column) -> Column:
    """Slots of a file's text; line ends inside the embedded map picture are no separators."""
    picture = F.regexp_extract(text, r'(?s)(<svg(?=[^>]{0,200}id="map").*?</svg>)', 1)
    safe = F.when(picture != "", F.replace(text, picture, F.replace(picture, F.lit("\r\n"), F.lit("\n")))).otherwise(text)
    return F.split(safe, "\r\n", -1)


def slot(i: int, of: str = "slots") -> Column:
    """Slot i, null if it is empty or beyond the last."""
    return F.nullif(F.try_element_at(F.col(of), F.lit(i + 1)), F.lit(""))


def header(files: DataFrame) -> DataFrame:
    part = F.split(slot(0), r"\|", -1)
    at = lambda k: F.try_element_at(part, F.lit(k + 1))
    kinds = {"graph_width": "int", "graph_height": "int"}
    rows = files.where(F.size(part) >= 6)
    return rows.select("path", *(at(k).try_cast(kinds.get(n, "string")).alias(n) for k, n in enumerate(HEADER[:6])), F.coalesce(at(6).try_cast("decimal(20,0)"), F.lit(0)).alias("map_id"))


def number(text: Column, kind: str) -> Column:
    """A number of a CSV slot: bad text is 0; u8 is clamped, the other integers wrap, f32 is a float."""
    x = F.coalesce(F.trim(text).try_cast("double"), F.lit(0.0))
    if kind == "f32":
        return x.cast("float")
    whole = F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long")
    if kind == "u8":
        return F.least(F.greatest(whole, F.lit(0)), F.lit(255)).cast("int")
    if kind == "u16":
        return F.pmod(whole, F.lit(65536)).cast("int")
    return (F.pmod(whole + 128, F.lit(256)) - 128).cast("int")


def numbers(text: Column, kind: str) -> Column:
    """All numbers of a CSV slot; empty tokens are left out."""
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: number(x, kind))


def cell_columns(files: DataFrame, columns: dict[int, tuple[str, str]]) -> DataFrame:
    """path, cell_id and the columns of the given slots, zipped by position; lengths must be equal or zero."""
    arrays = files.select("path", *(F.coalesce(numbers(slot(i), k), F.array().cast(f"array<{'float' if k == 'f32' else 'int'}>")).alias(n) for i, (n, k) in columns.items()))
    names = [n for n, _ in columns.values()]
    most = F.greatest(*(F.size(n) for n in names))
    bad = F.concat_ws(", ", *(F.when((F.size(n) > 0) & (F.size(n) != most), F.lit(n)) for n in names))
    checked = arrays.withColumn("zipped", F.when(bad == "", F.arrays_zip(*names)).otherwise(F.raise_error(F.concat(F.lit("lengths differ: "), bad)).cast(arrays.select(F.arrays_zip(*names).alias("z")).schema["z"].dataType)))
    return checked.select("path", F.posexplode("zipped").alias("cell_id", "z")).select("path", F.col("cell_id").cast("long").alias("cell_id"), "z.*")


def sanitised(text: Column) -> Column:
    """JSON text with escapes of unpaired surrogates replaced by a question mark."""
    high, low = r"\\u[dD][89abAB][0-9a-fA-F]{2}", r"\\u[dD][c-fC-F][0-9a-fA-F]{2}"
    return F.regexp_replace(text, rf"(?<!\\)(?:{high}(?!{low})|(?<!{high}){low})", "?")


def one_of(text: Column, domain: tuple[str, ...]) -> Column:
    """The text in lower case if it is in a closed domain, else the domain's last."""
    return F.when(F.lower(text).isin(*domain), F.lower(text)).otherwise(domain[-1])


def feature_kind(text: Column) -> Column:
    """ocean, island or lake; all kinds of land are islands, unknown kinds oceans."""
    return F.when(text.isin(*LAND), "island").when(text == "lake", "lake").otherwise("ocean")


def flag(text: Column) -> Column:
    """JSON flags: absent, false and 0 are false."""
    return F.coalesce(~F.lower(text).isin("", "0", "false", "null"), F.lit(False))


def path_cells(text: Column) -> Column:
    """Cells of a river's path; a negative one is the map's edge."""
    return F.transform(F.from_json(text, "array<long>"), lambda c: F.when(c < 0, F.lit(UNSET_CELL)).otherwise(c))


def ids(text: Column) -> Column:
    """The elements of a JSON array that are unsigned whole numbers; empty for anything else."""
    found = F.filter(F.from_json(text, "array<string>"), lambda x: x.rlike("^[0-9]+$"))
    return F.coalesce(F.transform(found, lambda x: x.try_cast("long")), F.array().cast("array<long>"))


#: How the text of a JSON field becomes a column, by its kind; other kinds are SQL types.
_READ = {
    "flag": flag, "ids": ids, "path": path_cells, "feature": feature_kind, "people": lambda x: one_of(x, PEOPLE), "culture": lambda x: one_of(x, PEOPLE_OR_LAKE),
    "form": lambda x: one_of(x, FORMS),
}


def _derived(rows: DataFrame, name: str) -> DataFrame:
    """Columns that follow from others: the groups of features and the port of a burg."""
    if name == "features":
        lake = F.when((F.col("kind") == "lake") & F.col("group").isin(*LAKES), F.col("group"))
        return rows.withColumns({"land_group": F.when(F.col("is_land"), one_of(F.coalesce("group", F.lit("")), LAND)), "lake_group": lake}).drop("group")
    if name == "burgs":
        return rows.withColumn("port_feature", F.when(F.col("port"), F.col("feature"))).drop("port")
    return rows


def catalog(files: DataFrame, name: str) -> DataFrame:
    """path, pos and the fields of a JSON catalog; elements that are no objects are left out, as is a placeholder."""
    at, skip, fields = CATALOGS[name]
    rows = files.select("path", F.posexplode_outer(F.from_json(sanitised(slot(at)), "array<string>")).alias("pos", "item"))
    rows = rows.where(F.col("item").startswith("{") & (F.lit(not skip) | (F.col("pos") > 0)))
    text = lambda key: F.get_json_object("item", f"$.{key}")
    return _derived(rows.select("path", "pos", *((_READ[kind](text(key)) if kind in _READ else text(key).try_cast(kind)).alias(n) for n, (key, kind) in fields.items())), name)


def grid_general(files: DataFrame) -> DataFrame:
    """path, spacing, cells_x, cells_y, cells_desired (all cells, if the file says 0), points, boundary of the grid."""
    schema = "struct<spacing:float,cellsX:long,cellsY:long,cellsDesired:long,points:array<array<float>>,boundary:array<array<float>>>"
    g = files.where(slot(6).isNotNull()).select("path", F.from_json(slot(6), schema).alias("g"))
    desired = F.expr("coalesce(nullif(g.cellsDesired, 0), g.cellsX * g.cellsY)")
    point = lambda name: F.transform(f"g.{name}", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    return g.select("path", "g.spacing", F.col("g.cellsX").alias("cells_x"), F.col("g.cellsY").alias("cells_y"), desired.alias("cells_desired"), point("points").alias("points"), F.coalesce(point("boundary"), F.array().cast("array<struct<x:float,y:float>>")).alias("boundary"))


def grid_features(files: DataFrame) -> DataFrame:
    """path, id, kind, is_land, touches_border, land_group of the grid's features; land is an island."""
    items = files.select("path", F.posexplode_outer(F.from_json(F.get_json_object(slot(6), "$.features"), "array<string>")).alias("pos", "item")).where("pos > 0 AND item LIKE '{%'")
    text = lambda key: F.get_json_object("item", f"$.{key}")
    rows = items.select("path", text("i").try_cast("long").alias("id"), feature_kind(text("type")).alias("kind"), flag(text("land")).alias("is_land"), flag(text("border")).alias("touches_border"))
    return rows.where("id IS NOT NULL").withColumn("land_group", F.when(F.col("is_land"), "island"))


def grid_feature_kinds(files: DataFrame) -> DataFrame:
    """path, id, kind for every id from 0 to the largest; ids that no feature has are oceans."""
    found = grid_features(files).groupBy("path", "id").agg(F.max_by("kind", "id").alias("kind"))
    every = found.groupBy("path").agg(F.max("id").alias("most")).select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("most"))).alias("id"))
    return every.join(found, ["path", "id"], "left").select("path", "id", F.coalesce("kind", F.lit("ocean")).alias("kind"))


def coordinates(files: DataFrame) -> DataFrame:
    at = lambda k: F.get_json_object(slot(2), f"$.{k}").try_cast("float")
    return files.select("path", at("latT").alias("lat_t"), at("latN").alias("lat_n"), at("latS").alias("lat_s"), F.coalesce(at("lonL"), at("lonW"), F.lit(0.0)).alias("lon_l"), F.coalesce(at("lonR"), at("lonE"), F.lit(0.0)).alias("lon_r"), slot(2).alias("extras"))


def settings(files: DataFrame) -> DataFrame:
    part = F.split(slot(1), r"\|", -1)
    at = lambda k: F.try_element_at(part, F.lit(k + 1))
    n = lambda k, kind: F.coalesce(at(k).try_cast(kind), F.lit(0).cast(kind))
    return files.where(F.size(part) >= 20).select("path", at(0).alias("distance_unit"), n(1, "float").alias("distance_scale"), at(2).alias("area_unit"), at(3).alias("height_unit"), n(4, "double").alias("height_exponent"), at(5).alias("temperature_unit"), at(19).alias("options"), at(20).alias("map_name"), (F.coalesce(at(21), F.lit("")).isin("", "0") == F.lit(False)).alias("hide_labels"), at(22).alias("style_preset"))


def route_map(files: DataFrame) -> DataFrame:
    """path, src, dst, route_id of the nested map in slot 36; keys that are no numbers are left out."""
    outer = files.select("path", F.explode(F.from_json(slot(36), "map<string,map<string,bigint>>")).alias("src", "to"))
    return outer.select("path", F.col("src").try_cast("long").alias("src"), F.explode("to").alias("dst", "route_id")).select("path", "src", F.col("dst").try_cast("long").alias("dst"), "route_id").where("src IS NOT NULL AND dst IS NOT NULL")


def biomes(files: DataFrame) -> DataFrame:
    group = lambda k: F.split(F.try_element_at(F.split(slot(3), r"\|", -1), F.lit(k + 1)), ",")
    rows = files.select("path", F.posexplode(F.arrays_zip(group(0).alias("color"), group(1).alias("habitability"), group(2).alias("name"))).alias("id", "z"))
    return rows.select("path", "id", "z.color", F.col("z.habitability").try_cast("float").alias("habitability"), F.lit(50.0).alias("move_cost"), "z.name")


def notes(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.from_json(sanitised(slot(4)), "array<struct<id:string,name:string,legend:string>>")).alias("id", "n"))
    return rows.select("path", "id", F.concat("n.name", F.lit("\n\n"), "n.legend").alias("content"), F.col("n.id").alias("linked_id"))


def namebases(files: DataFrame) -> DataFrame:
    rows = files.select("path", F.posexplode(F.split(slot(31), "/")).alias("id", "entry")).withColumn("f", F.split("entry", r"\|", -1)).where("size(f) >= 5")
    # The file's fourth field is read once as text and once as the number m; b is the field after it.
    return rows.select("path", "id", F.col("f")[0].alias("name"), F.col("f")[1].try_cast("int").alias("min_length"), F.col("f")[2].try_cast("int").alias("max_length"), F.col("f")[3].alias("d"), F.coalesce(F.col("f")[3].try_cast("float"), F.lit(0.0)).alias("m"), F.col("f")[4].alias("b"))


def mesh_inputs(files: DataFrame) -> DataFrame:
    """What the geometry of each file is made from, as operators.mesh.regenerated() takes it."""
    part = F.split(slot(0), r"\|", -1)
    schema = "struct<cellsX:long,cellsY:long,cellsDesired:long,points:array<string>,features:array<string>>"
    field = lambda x, key: F.get_json_object(x, f"$.{key}")
    lakes = F.filter(F.slice(F.col("g.features"), 2, 1_000_000_000), lambda x: feature_kind(field(x, "type")) == "lake")
    of = lambda at, kind: F.coalesce(numbers(slot(at), kind), F.array().cast("array<int>")).cast("array<long>")
    rows = files.select("path", "slots", F.from_json(slot(6), schema).alias("g"), F.when(F.size(part) >= 6, part).alias("h"))
    return rows.select(
        "path", F.col("h")[3].alias("seed"), F.col("h")[4].try_cast("double").alias("width"), F.col("h")[5].try_cast("double").alias("height"),
        F.expr("coalesce(nullif(g.cellsDesired, 0), g.cellsX * g.cellsY)").alias("desired"), F.coalesce(F.size("g.points"), F.lit(0)).cast("long").alias("n_points"),
        of(7, "u8").alias("heights"), of(10, "i8").alias("water"), of(9, "u16").alias("features"),
        F.coalesce(F.filter(F.transform(lakes, lambda x: field(x, "i").try_cast("long")), lambda i: i.isNotNull()), F.array().cast("array<long>")).alias("lakes"),
        F.array(*(F.lit(n) for n, _ in PACK.values())).alias("names"), F.array(*(F.coalesce(F.size(numbers(slot(i), k)), F.lit(0)) for i, (_, k) in PACK.items())).alias("sizes"),
    )


def with_mesh(files: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(grid cells, packed cells, errors: path, message): the cells made anew, joined by position with the columns of their file; a file with an error has no cells.

    cells: as operators.mesh.regenerated() gives them, written once.
    """
    errors = cells.where("part = 'error'").select("path", "message")
    sound = files.join(errors.select("path"), "path", "left_anti")
    own = lambda part: cells.where(F.col("part") == part).drop("part", "message")
    grid = own("grid").drop("grid_id").join(cell_columns(sound, {k: v for k, v in GRID.items() if v[0] not in ("height", "feature_id")}), ["path", "cell_id"], "left")
    return grid, own("pack").join(cell_columns(sound, PACK), ["path", "cell_id"], "left"), errors
