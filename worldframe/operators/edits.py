"""Edit commands as copy-on-write updates: one batch of commands, the last of each entity and field wins."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Commands: seq, entity, id, op, value.
HEX = r"^#?[0-9a-fA-F]{6}$"


def _free(name: str, *frames: DataFrame) -> str:
    """A name like this that no column of the frames has (names differ by case too)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name in taken:
        name += "_"
    return name


def checked(commands: DataFrame, entities: DataFrame, entity: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) commands on one kind of entity; rejected ones carry an error."""
    own = _free("known", commands)
    known = entities.where((F.col("id") != 0) & ~F.col("removed")).select(F.col("id").alias(own))
    mine = commands.where(F.col("entity") == entity).join(known, F.col("id") == F.col(own), "left")
    error = (
        F.when(F.col(own).isNull(), "EntityNotFound")
        .when((F.col("op") == "rename") & (F.trim("value") == ""), "EmptyName")
        .when((F.col("op") == "recolor") & ~F.col("value").rlike(HEX), "InvalidHexColor")
    )
    marked = mine.withColumn("error", error).drop(own)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def last_writes(commands: DataFrame) -> DataFrame:
    """The last command of each entity, id and op."""
    w = Window.partitionBy("entity", "id", "op").orderBy(F.desc("seq"))
    k = _free("k", commands)
    return commands.withColumn(k, F.row_number().over(w)).where(F.col(k) == 1).drop(k)


def apply(entities: DataFrame, commands: DataFrame, entity: str) -> DataFrame:
    """entities with names (trimmed), colours (normalised) and, where they have one, government forms (op form) of the accepted commands."""
    ok = last_writes(checked(commands, entities, entity)[0])
    colour = F.concat(F.lit("#"), F.lower(F.regexp_replace("value", "^#", "")))
    told = {"name": ("rename", F.trim("value")), "colour": ("recolor", colour), "form": ("form", F.col("value"))}
    new = {c: _free(f"new_{c}", entities) for c in told}
    wide = ok.groupBy("id").agg(*[F.max(F.when(F.col("op") == op, value)).alias(new[c]) for c, (op, value) in told.items()])
    joined = entities.join(wide, "id", "left")
    return joined.withColumns({c: F.coalesce(new[c], c) for c in told if c in entities.columns}).select(*entities.columns)


def capitals(burgs: DataFrame, states: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(burgs, states) after commands of op capital (value true or false) on burgs, in order of seq.

    A burg made capital takes the rank from the others of its state (but not in state 0) and gives the state its cell as centre.
    burgs: id, cell, state, removed, is_capital; states: id, center_cell.
    """
    mine = checked(commands.where(F.col("op") == "capital"), burgs, "burg")[0].select("id", "seq", (F.col("value") == "true").alias("on"))
    told = mine.join(burgs.select("id", "state", "cell"), "id")
    seq, on, last, cell = (_free(n, burgs, states) for n in ("told_seq", "told_on", "last_seq", "last_cell"))
    own = told.groupBy("id").agg(F.max("seq").alias(seq), F.max_by("on", "seq").alias(on))
    raised = told.where("on AND state > 0").groupBy("state").agg(F.max("seq").alias(last), F.max_by("cell", "seq").alias(cell))
    joined = burgs.join(own, "id", "left").join(raised.drop(cell), "state", "left")
    now = F.when(F.col(last).isNull(), F.coalesce(F.col(on), F.col("is_capital"))).otherwise(F.coalesce(F.col(on) & (F.col(seq) == F.col(last)), F.lit(False)))
    seated = states.join(raised.select(F.col("state").alias("id"), cell), "id", "left").withColumn("center_cell", F.coalesce(cell, "center_cell"))
    return joined.withColumn("is_capital", now).select(*burgs.columns), seated.select(*states.columns)


def selection(chosen: DataFrame, entities: dict[str, DataFrame]) -> DataFrame:
    """chosen with name and colour buffers of the entity that each row (entity, id) selects; kinds that are not given, and unknown ids, leave them empty."""
    rows = [df.select(F.lit(kind).alias("entity"), "id", "name", (F.col("colour") if "colour" in df.columns else F.lit("")).alias("colour")) for kind, df in entities.items()]
    known = rows[0]
    for more in rows[1:]:
        known = known.unionByName(more)
    return chosen.join(known, ["entity", "id"], "left").withColumns({"name": F.coalesce("name", F.lit("")), "colour": F.coalesce("colour", F.lit(""))})
