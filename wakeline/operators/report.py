"""What is told of a run: later paths of cards, cases near hotspots, a summary of figures, Markdown and a checked bundle."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Future
from ..functions.geo import plane
from .future import KEY, edges, followup, overlaps
from .graph import settled
from .publish import HIDDEN, IDENTITY

#: What is said with every summary.
NOTICE = "Figures are cues for human review. They are no alarms, incident labels or findings."


def relative_paths(cards: DataFrame, f: DataFrame, u: Future = Future(), step_s: int = 30, digits: int = 2) -> DataFrame:
    """Where both vessels of a card went while both were seen, in miles from their middle at t0 and seconds after it: no names, times or places.

    ``cards``: the key of an episode, ``case_id``, ``lon_mid``, ``lat_mid``, ``tcpa_min``. A row for each time of a common stretch and vessel: the stretch's
    ends, every ``step_s`` from its begin, the predicted and the observed moment of the least distance if they lie in it. Cards without a common stretch have no row.
    """
    e = settled(edges(followup(cards, f, u), u))
    o = overlaps(e)
    before = Window.partitionBy(*KEY).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce((F.col("s") > F.max("e").over(before)).cast("int"), F.lit(1))
    stretch = F.sum("_new").over(Window.partitionBy(*KEY).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0))
    common = o.withColumn("_new", new).withColumn("_stretch", stretch).groupBy(*KEY, "_stretch").agg(F.min("s").alias("begin"), F.max("e").alias("end"))
    nearest = o.groupBy(*KEY).agg(F.min_by("at", F.struct("d", "s")).alias("observed"))
    own = common.join(nearest, KEY).join(cards.select(*KEY, "case_id", "lon_mid", "lat_mid", "tcpa_min"), KEY)
    moments = F.filter(F.array(F.col("t0") + F.col("tcpa_min") * 60.0, F.col("observed")), lambda x: (x >= F.col("begin")) & (x <= F.col("end")))
    steps = F.transform(F.sequence("begin", "end", F.lit(step_s).cast("bigint")), lambda x: x.cast("double"))
    times = F.array_distinct(F.concat(steps, F.array(F.col("end").cast("double")), moments))
    there = own.withColumn("at", F.explode(times)).join(e, KEY).where((F.col("s") <= F.col("at")) & (F.col("at") <= F.col("e")))
    part = (F.col("at") - F.col("s")) / (F.col("e") - F.col("s"))
    place = F.struct(*[(F.col(f"{c}0") + (F.col(f"{c}1") - F.col(f"{c}0")) * part).alias(c) for c in "xy"])
    spot = there.groupBy("case_id", "begin", "end", "at", "side", "t0", "lon_mid", "lat_mid").agg(F.min_by(place, "s").alias("p"))
    x, y = plane(F.col("p.x"), F.col("p.y"), F.col("lon_mid"), F.col("lat_mid"))
    after = lambda c: F.round(F.col(c) - F.col("t0")).cast("bigint")
    return spot.select("case_id", after("begin").alias("start_t_s"), after("end").alias("end_t_s"), F.upper("side").alias("label"), after("at").alias("t_s"), F.round(x, digits).alias("x_nm"), F.round(y, digits).alias("y_nm"))


def card_cases(cards: DataFrame, cases: DataFrame, points: DataFrame, cells: int = 5, most: int = 5) -> DataFrame:
    """The cases whose fullest cells a hotspot card stands for: ``card_id``, ``cell_id``, ``related_case_ids`` (empty if there are none).

    A case's cells are those with most of its points, ties by cell id; both limits are the card's own. Cases are few, so they are broadcast.
    """
    on = points.where("cell_id IS NOT NULL").join(F.broadcast(cases.select("case_no", "date", "track_id")), ["date", "track_id"])
    order = Window.partitionBy("case_no").orderBy(F.desc("n"), "cell_id")
    top = on.groupBy("case_no", "cell_id").agg(F.count("*").alias("n")).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= cells)
    near = top.groupBy("cell_id").agg(F.slice(F.array_sort(F.collect_list("case_no")), 1, most).alias("_cases"))
    names = F.transform(F.coalesce("_cases", F.array().cast("array<int>")), lambda i: F.format_string("case_%02d", i))
    return cards.select("card_id", "cell_id").join(near, "cell_id", "left").select("card_id", "cell_id", names.alias("related_case_ids"))


def figures(**sections: DataFrame) -> DataFrame:
    """One-row tables of numbers as rows: section, name, value. A column that is null, or a table without a row, gives none."""
    out = None
    for section, one in sections.items():
        long = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 6).alias("value")) for c in one.columns])).alias("x"))
        rows = long.select(F.lit(section).alias("section"), "x.name", "x.value").where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def counted(df: DataFrame, column: str) -> DataFrame:
    """How many rows have each value of a column with few of them, as rows for ``figures``' sections: section, name, value."""
    return df.groupBy(column).agg(F.count("*").cast("double").alias("value")).where(F.col(column).isNotNull()).select(F.lit(column).alias("section"), F.col(column).alias("name"), "value")


def summary_json(rows: DataFrame, **about: object) -> str:
    """Figures, some dozens, as one document by section."""
    sections: dict[str, dict] = {}
    for r in rows.orderBy("section", "name").collect():
        v = r["value"]
        sections.setdefault(r["section"], {})[r["name"]] = int(v) if v == int(v) else v
    return json.dumps({**about, "notice": NOTICE, **sections}, indent=2, ensure_ascii=False)


def markdown(df: DataFrame, title: str, order: list[str], note: str = "") -> str:
    """A table of a report's size as Markdown: nulls are empty, bars are escaped, numbers stand to the right."""
    cell = lambda v: "" if v is None else (f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    right = [k in ("int", "bigint", "double", "float", "smallint", "tinyint") for _, k in df.dtypes]
    lines = [f"# {title}", "", *([note, ""] if note else []), "| " + " | ".join(df.columns) + " |", "|" + "|".join("-:" if r else "-" for r in right) + "|"]
    lines += ["| " + " | ".join(map(cell, r)) + " |" for r in df.orderBy(*order).collect()]
    return "\n".join(lines) + "\n"


def exposures(text: str) -> list[str]:
    """Hidden field names and identities that a document to be published holds; there must be none."""
    names = [n for n in re.findall(r'"([A-Za-z_]+)"\s*:', text) if n in HIDDEN]
    return sorted(set(names)) + sorted({m.group() for m in re.finditer(IDENTITY, text)})


def write_bundle(df: DataFrame, path: str, checks: DataFrame, **about: object) -> str:
    """Documents (``name``, ``content``: a bundle's few) under ``path`` and a manifest of them, or an error and no file at all.

    Nothing is written if a check of the outputs against each other fails, or if a document names what must stay hidden.
    """
    failed = [r["check"] for r in checks.where("NOT ok").select("check").collect()]
    if failed:
        raise ValueError(f"outputs contradict each other: {', '.join(sorted(failed))}")
    documents = {r["name"]: r["content"] for r in df.orderBy("name").collect()}
    for name, content in documents.items():
        if found := exposures(content):
            raise ValueError(f"{name} holds {', '.join(found[:5])}")
    files = [{"name": n, "bytes": len(c.encode()), "sha256": hashlib.sha256(c.encode()).hexdigest()} for n, c in documents.items()]
    documents["manifest.json"] = json.dumps({**about, "file_count": len(files), "files": files}, indent=2, sort_keys=True)
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for name, content in documents.items():
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(folder, name), True)
        try:
            out.write(bytearray(content.encode()))
        finally:
            out.close()
    return documents["manifest.json"]
