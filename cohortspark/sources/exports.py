"""CSV exports with an explicit row order.

A split file is read in order inside each split, so (split start, running id) orders
the rows of a file of any size without reading it in one task. Columns arrive as
text and are parsed where they are used.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortspark.functions import number_sql, to_int
from cohortspark.operators.joins import stack
from cohortspark.plans.scales import KeyItem, SurveyKeys


# quotes inside a quoted answer are doubled; blanks around an answer do not count
CSV = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True,
}


def _plain_stem(path: str) -> str:
    return path.rstrip("/").split("/")[-1].rsplit(".", 1)[0]


def ordinal_columns() -> dict[str, Column]:
    """Position of a row: ``file_path``, ``split_start`` and ``row_ord`` within the split."""
    return {
        "file_path": F.col("_metadata.file_path"),
        "split_start": F.col("_metadata.file_block_start"),
        "row_ord": F.monotonically_increasing_id(),
    }


def _headers(spark: SparkSession, paths: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Files grouped by their header line; only first lines are read, several files at a time."""
    groups: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(max_workers=16) as pool:
        headers = list(pool.map(lambda path: spark.read.csv(path, **CSV).columns, paths))
    for path, names in zip(paths, headers, strict=True):
        groups.setdefault(tuple(names), []).append(path)
    return groups


def _read_text_columns(
    spark: SparkSession, names: Sequence[str], paths: Sequence[str], multi_line: bool
) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    read = spark.read.csv(list(paths), schema=schema, multiLine=multi_line, **CSV)
    kept = [F.expr(f"nullif(`{n}`, 'NA') AS `{n}`") for n in names]
    return read.select(*kept, *[c.alias(n) for n, c in ordinal_columns().items()])


def _place(path: str) -> str:
    """Host and plain path of a file, whatever its scheme and escapes."""
    parts = urlsplit(path)
    return f"{parts.netloc}{unquote(parts.path)}"


def file_ranks(found: Sequence[str], paths: Sequence[str]) -> dict[str, int]:
    """Place in ``paths``, as the caller wrote them, of every path that a listing found."""
    ranks = {_place(p): rank for rank, p in enumerate(paths)}
    placed = {}
    for path in found:
        place = _place(path)
        if place not in ranks:  # listed by a relative path
            place = next(p for p in ranks if place.endswith(f"/{p.removeprefix('./')}"))
        placed[path] = ranks[place]
    return placed


def _with_file_order(rows: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Replace ``file_path`` by ``source`` (file stem) and ``file_rank`` (place in ``paths``).

    Files are told apart by their whole path, so equal names in several folders are fine.
    """
    spark = rows.sparkSession
    listed = spark.read.format("binaryFile").load(list(paths)).select("_metadata.file_path")
    found = file_ranks([path for (path,) in listed.collect()], paths)
    known = [(path, _plain_stem(_place(path)), rank) for path, rank in found.items()]
    # from pandas, so that Catalyst knows its size and chooses the join by it
    frame = pd.DataFrame(known, columns=["_path", "source", "file_rank"])
    table = spark.createDataFrame(frame, "_path string, source string, file_rank int")
    placed = rows.join(table, F.col("file_path") == F.col("_path"), "left")
    return placed.drop("file_path", "_path")


def read_trials(
    spark: SparkSession,
    paths: Sequence[str],
    integers: Sequence[str] = ("Timed Out",),
    multi_line: bool = False,
) -> DataFrame:
    """Trial logs stacked by column name, with ordinal columns; ``paths`` gives the file order.

    Files of one layout share a scan. ``integers`` lists columns whose type differs
    between files.
    """
    if len(set(paths)) != len(paths):
        raise ValueError("a trial file is listed twice")
    parts = [
        _read_text_columns(spark, names, group, multi_line)
        for names, group in _headers(spark, paths).items()
    ]
    stacked = _with_file_order(stack(parts), paths)
    return stacked.withColumns({c: to_int(F.col(f"`{c}`")) for c in integers})


def discover(spark: SparkSession, folder: str, suffix: str = "first") -> DataFrame:
    """Files of a folder whose stem ends in ``suffix``: ``path``, ``source``, ``length``."""
    listed = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"*{suffix}.*")
        .load(folder)
        .select("path", "length")
    )
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    return listed.withColumn("source", stem).filter(F.endswith("source", F.lit(suffix)))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records of a CSV file of any size and number of splits: ``record`` (from 1) and ``text``.

    A line break ends a record where the quotes so far are even. Each split tells the parity of
    its quotes and how many records start in it for both states that it may be entered in;
    sums over the splits then give the state and the record number at its first line. Lines
    that are records by themselves stay where they are; only the others are put together.
    """
    lines = spark.read.text(path, lineSep="\n").select(
        "value", *[c.alias(n) for n, c in ordinal_columns().items()]
    )
    split = ["file_path", "split_start"]
    inside = Window.partitionBy(*split).orderBy("row_ord")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    before = F.sum("_quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_quotes", quotes % 2).withColumn("_before", F.coalesce(before, F.lit(0)) % 2)
    lines = lines.withColumn("_blank", F.trim(F.replace("value", F.lit("\r"))) == "")

    ordered = Window.partitionBy("file_path").orderBy("split_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = [F.count_if((F.col("_before") == state) & ~F.col("_blank")) for state in (0, 1)]
    splits = lines.groupBy(*split).agg(
        (F.sum("_quotes") % 2).alias("_parity"), *(s.alias(f"_starts{n}") for n, s in enumerate(starts))
    )
    splits = splits.withColumn("_entry", F.coalesce(F.sum("_parity").over(ordered), F.lit(0)) % 2)
    own = F.when(F.col("_entry") == 0, F.col("_starts0")).otherwise(F.col("_starts1"))
    splits = splits.withColumn("_past", F.coalesce(F.sum(own).over(ordered), F.lit(0)))

    placed = lines.join(splits.select(*split, "_entry", "_past"), split)
    outside = (F.col("_before") + F.col("_entry")) % 2 == 0
    placed = placed.filter(~(outside & F.col("_blank"))).withColumn("_start", outside)
    record = F.col("_past") + F.count_if("_start").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = placed.withColumn("record", record)
    whole = F.col("_start") & (F.col("_quotes") == 0)
    single = placed.filter(whole).select("record", F.col("value").alias("text"))
    part = F.struct("split_start", "row_ord", "value")
    joined = placed.filter(~whole).groupBy("file_path", "record").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    several = joined.select("record", F.array_join("parts.value", "\n").alias("text"))
    text = F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n"))
    return single.unionByName(several).select("record", text.alias("text"))


def read_survey(
    spark: SparkSession,
    path: str,
    extra_header_rows: int = 2,
    numbers: Sequence[str] = (),
    multi_line: bool = True,
) -> DataFrame:
    """Survey export as text columns plus ordinal columns.

    ``extra_header_rows`` descriptive rows follow the header. Columns whose name contains
    one of ``numbers`` are parsed as doubles. Answers may contain line breaks, in quotes; inside
    them a quote is doubled, and quotes do not occur elsewhere. A file is read in as many
    splits as its size asks for. ``multi_line`` off is for files without such breaks, which
    saves putting records together.
    """
    names = spark.read.csv(path, multiLine=multi_line, **CSV).columns
    if multi_line:
        schema = ", ".join(f"c{n} string" for n in range(len(names)))
        options = {k: str(v).lower() if isinstance(v, bool) else v for k, v in CSV.items() if k != "header"}
        rows = _records(spark, path).filter(F.col("record") > 1 + extra_header_rows)
        parsed = rows.select("record", F.from_csv("text", schema, options).alias("row"))
        body = parsed.select(
            *(F.nullif(F.col(f"row.c{n}"), F.lit("NA")).alias(name) for n, name in enumerate(names)),
            F.lit(0).cast("long").alias("split_start"),
            (F.col("record") - 2).cast("long").alias("row_ord"),  # rows after the header, from 0
        )
    else:
        body = _read_text_columns(spark, names, [path], multi_line).drop("file_path")
        # row ids are consecutive inside the first split, wherever they start
        head = F.col("split_start") == 0
        first = body.filter(head).agg(F.min("row_ord")).scalar()
        body = body.filter(~head | (F.col("row_ord") >= first + extra_header_rows))
    wanted = [n for n in names if any(part in n for part in numbers)]
    return body.withColumns({n: F.expr(number_sql(n)) for n in wanted}) if wanted else body


def read_stimuli(spark: SparkSession, path: str) -> DataFrame:
    """Stimulus levels as exported."""
    schema = "fname string, amuse double, fear double, bipolar double"
    names = spark.read.csv(path, **CSV).columns
    read = spark.read.csv(path, schema=", ".join(f"`{n}` string" for n in names), **CSV)
    wanted = T.StructType.fromDDL(schema)
    return read.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in wanted])


def read_key(
    spark: SparkSession,
    path: str,
    scale: str,
    item: str = "q.number",
    subscale: str = "subscale",
    reverse: str | None = None,
    starred: str | None = None,
) -> DataFrame:
    """One questionnaire key as ``(scale, item, subscale, reverse)``.

    ``starred`` names a column ``<number><gap><text>`` whose text ends in ``*`` for
    reversed items; it replaces ``item`` and ``reverse``.
    """
    table = spark.read.csv(path, **CSV)
    if starred:
        question = F.col(f"`{starred}`")
        number = F.regexp_extract(question, "^([0-9]+)", 1)
        flag = F.endswith(question, F.lit("*"))
    else:
        number = F.col(f"`{item}`")
        flag = F.col(f"`{reverse}`").try_cast("boolean") if reverse else F.lit(None).cast("boolean")
    return table.select(
        F.lit(scale).alias("scale"),
        to_int(number).alias("item"),
        F.nullif(F.col(f"`{subscale}`"), F.lit("NA")).alias("subscale"),
        flag.alias("reverse"),
    )


# Key-file columns per questionnaire.
KEY_LAYOUTS: Mapping[str, dict] = {
    "bpq": {"starred": "question"},
    "tas20": {"item": "q.number", "reverse": "reverse"},
    "ders": {"item": "q.num", "reverse": "reverse"},
    "als18": {"item": "q.number", "subscale": "subscale.6"},
    "beq": {"item": "q.number", "reverse": "reverse"},
    "cesdr": {"item": "q.number"},
    "sticsa": {"item": "q.number"},
    "irq": {"item": "q.number"},
}


def survey_keys(spark: SparkSession, paths: Mapping[str, str]) -> SurveyKeys:
    """Keys for :func:`cohortspark.operators.scoring.score_wide`.

    A key has one row per question of a printed questionnaire, which is what makes it
    safe to read on the driver; its rows become expressions of the plan.
    """
    tables = [read_key(spark, path, scale, **KEY_LAYOUTS[scale]) for scale, path in paths.items()]
    keys = SurveyKeys()
    for row in reduce(DataFrame.unionByName, tables).orderBy("scale", "item").toLocalIterator():
        keys.items.setdefault(row["scale"], []).append(
            KeyItem(row["item"], row["subscale"], row["reverse"])
        )
    return keys
