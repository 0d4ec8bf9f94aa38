"""Load tables from a text dump of INSERT statements and COPY blocks.

The dump is plain text, so Spark splits it among tasks by line. What a line means hangs
on what stands before it: it may lie in a COPY block, begin inside a quoted text, or
continue the rows of a statement. Each of the three states is carried in the same way.
Windows over the lines of a file split give the state relative to the split's beginning,
one row for each split says what the split does to the state, and a window over these
rows gives the state at its beginning. No window over lines holds more than one split.

A quoted text is open or closed: a line sets that, turns it over, or leaves it. The text
outside quotes is cut behind each ``)`` and ``;``, so that the unit put together from
several lines is one row of values, however many rows a statement has.

Literals are single-quoted with doubled inner quotes, numbers, or NULL; binary text is
``'\\x' + hex``. COPY blocks have tab-separated values with backslash escapes. A list of
columns gives the order of values; columns that are not listed are NULL. A header
(``INSERT INTO … (columns)``, ``COPY … FROM stdin;``) stands on one line.

No row is skipped: an INSERT or COPY for a table without a declaration or in another
form, a row that does not fit its columns, and a file that ends inside a text, a
statement or a block fail the job.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlet.session import scratch_path
from martlet.sources.schemas import RETAIL, TableSpec

_TABLE = r'(?:"?\w+"?\.)?"?(\w+)"?'
_INSERT = rf"(?is)^\s*INSERT\s+INTO\s+{_TABLE}\s*(?:\(([^)]*)\)|(?:OVERRIDING|VALUES)\b.*|)\z"
_INSERT_LIKE = r"(?i)^\s*INSERT\s+INTO\b"
_COPY = rf"(?i)^\s*COPY\s+{_TABLE}\s*(?:\(([^)]*)\))?\s+FROM\s+stdin\s*;\s*$"
_COPY_LIKE = r"(?i)^\s*COPY\b.*\bFROM\s+stdin"
_COLUMNS_ONLY = r"(?is)^\s*INSERT\s+INTO\s+[^\s(]+\s*\("
_ROW = r"(?is)^\s*(?:,|(?:INSERT\s+INTO\s+\S+\s+)?(?:OVERRIDING\s+\w+\s+VALUE\s+)?VALUES)\s*\((.*)\)\z"
_END = r"(?is)^\s*(?:ON\s+CONFLICT\s+DO\s+NOTHING\s*)?;\z"
_COMMENT = r"(?s)('[^']*+(?:'|\z))|--.*"
#: Stands where texts are cut; no character, so that no valid text has it.
_CUT = "\uffff"
#: Escapes in COPY blocks, besides the backslash itself.
_ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}

_SPLIT = ("file", "split")


def _fail(what: str, text: Column, kind: str = "string") -> Column:
    return F.raise_error(F.concat(F.lit(f"unreadable INSERT or undeclared table{what}: "), text)).cast(kind)


def _in_order(*order: str, by: tuple[str, ...] = _SPLIT):
    """Windows over all rows before the current one, and up to it."""
    rows = Window.partitionBy(*by).orderBy(*order)
    first = Window.unboundedPreceding
    return rows.rowsBetween(first, -1), rows.rowsBetween(first, 0)


def _stage(df: DataFrame, folder: str) -> DataFrame:
    """Write ``df`` and read it back, so that what made it runs once."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _whole(order: str) -> Window:
    return Window.partitionBy("file").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def _outside_quotes(text: Column, change) -> Column:
    """``change`` applied to what lies outside quotes."""
    parts = F.transform(F.split(text, "'"), lambda part, i: F.when(i % 2 == 0, change(part)).otherwise(part))
    return F.array_join(parts, "'")


def _target(text: Column, pattern: str, specs: Mapping[str, TableSpec]) -> Column:
    """Table and listed columns of a header."""
    table, listed = F.lower(F.regexp_extract(text, pattern, 1)), F.regexp_extract(text, pattern, 2)
    columns = F.transform(F.split(listed, ","), lambda c: F.lower(F.regexp_replace(c, r'[\s"]', "")))
    return F.struct(
        F.when(table.isin([n.lower() for n in specs]), table).otherwise(_fail("", text)).alias("table_name"),
        F.when(F.trim(listed) != "", columns).alias("columns"),
    )


_NONE = "struct<table_name:string,columns:array<string>>"


def _read(spark: SparkSession, path: str, specs: Mapping[str, TableSpec]) -> DataFrame:
    """``file, split, line, text, block, starts``: each line and the COPY block it lies in (``table_name`` null: none)."""
    raw = spark.read.option("lineSep", "\n").text(path)
    lines = raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("line"),
        F.col("value").alias("text"),
    )
    lines = lines.withColumn("starts", F.col("text").rlike(_COPY_LIKE))
    header = F.when(F.col("text").rlike(_COPY), _target(F.col("text"), _COPY, specs)).otherwise(
        _fail("", F.col("text"), _NONE)
    )
    nothing = F.lit(None).cast(_NONE)
    none = F.struct(F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("array<string>").alias("columns"))
    event = F.when(F.col("starts"), header).when(F.rtrim(F.regexp_replace("text", r"\r$", "")) == "\\.", none)
    lines = lines.withColumn("event", event.otherwise(nothing))
    before, _ = _in_order("line")
    splits = lines.groupBy(*_SPLIT).agg(F.max_by("event", F.when(F.col("event").isNotNull(), F.col("line"))).alias("event"))
    earlier, _ = _in_order("split", by=("file",))
    at_end = F.last("event", ignorenulls=True).over(_whole("split"))["table_name"]
    splits = splits.select(
        *_SPLIT,
        F.last("event", ignorenulls=True).over(earlier).alias("carried"),
        at_end.isNotNull().alias("unended"),
    )
    local = lines.withColumn("local", F.last("event", ignorenulls=True).over(before)).drop("event")
    block = F.when(F.col("unended"), _fail(", the file ends in a COPY block", F.col("file"), _NONE)).otherwise(
        F.coalesce("local", "carried")
    )
    block = F.when(F.col("starts") & block["table_name"].isNotNull(), _fail(" in a COPY block", F.col("text"), _NONE)).otherwise(block)
    return local.join(splits, list(_SPLIT)).withColumn("block", block).drop("local", "carried", "unended")


def _copied(lines: DataFrame) -> DataFrame:
    """``table_name, columns, values`` of the lines in COPY blocks."""
    line = F.regexp_replace("text", r"\r$", "")

    def plain(value: Column) -> Column:
        def escaped(part: Column) -> Column:
            for letter, char in _ESCAPES.items():
                part = F.replace(part, F.lit("\\" + letter), F.lit(char))
            return F.when(part.contains("\\"), _fail(", escape", part)).otherwise(part)

        whole = F.array_join(F.transform(F.split(value, r"\\\\"), escaped), "\\")
        return F.when(value != "\\N", whole)

    rows = lines.where(F.col("block.table_name").isNotNull() & (F.rtrim(line) != "\\."))
    return rows.select("block.table_name", "block.columns", F.transform(F.split(line, "\t"), plain).alias("values"))


def _toggles(rows: DataFrame, order: str, by: tuple[str, ...]) -> DataFrame:
    """Adds ``base`` and ``turns`` before and up to each row, from ``fixed`` (null: not set here) and ``turn``.

    ``base`` is what the last row that sets the state sets, and the turns up to there.
    """
    before, upto = _in_order(order, by=by)
    rows = rows.withColumn("turns", F.sum("turn").over(upto)).withColumn("turns_before", F.col("turns") - F.col("turn"))
    base = F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns"))
    rows = rows.withColumn("base", base)
    return rows.withColumn("base_before", F.last("base", True).over(before)).withColumn("base", F.last("base", True).over(upto))


def _state(base: str, turns: str, at_start: Column) -> Column:
    turned = (F.col(turns) - F.coalesce(F.col(f"{base}.turns"), F.lit(0))) % 2 == 1
    return F.coalesce(F.col(f"{base}.fixed"), at_start) != turned


def _quotes(lines: DataFrame, folder: str) -> DataFrame:
    """Adds ``opened``: whether the line begins inside a quoted text."""

    def leaves_open(text: Column) -> Column:
        bare = F.regexp_replace(text, _COMMENT, "$1")
        return (F.length(bare) - F.length(F.replace(bare, F.lit("'"), F.lit("")))) % 2 == 1

    sql = ~F.col("starts") & F.col("block.table_name").isNull()
    if_closed = leaves_open(F.col("text"))
    if_open = leaves_open(F.concat(F.lit("'"), "text"))
    lines = lines.withColumn("fixed", F.when(sql & (if_closed == if_open), if_closed))
    lines = lines.withColumn("turn", F.when(sql & if_closed & ~if_open, 1).otherwise(0))
    lines = _stage(_toggles(lines, "line", _SPLIT), folder)
    splits = lines.groupBy(*_SPLIT).agg(F.max_by(F.struct("base", "turns"), "line").alias("s")).select(*_SPLIT, "s.*")
    closed = F.lit(False)
    splits = splits.select(
        *_SPLIT,
        F.when(F.col("base").isNotNull(), _state("base", "turns", closed)).alias("fixed"),
        F.when(F.col("base").isNull(), F.col("turns") % 2).otherwise(0).alias("turn"),
    )
    splits = _toggles(splits, "split", ("file",))
    last = F.last(_state("base", "turns", closed)).over(_whole("split"))
    splits = splits.select(
        *_SPLIT,
        F.when(last, _fail(", the file ends in a quoted text", F.col("file"), "boolean"))
        .otherwise(_state("base_before", "turns_before", closed))
        .alias("carried"),
    )
    lines = lines.join(splits, list(_SPLIT))
    opened = _state("base_before", "turns_before", F.col("carried"))
    # What looks like the header of a block may be a line of a text; which one it is cannot be told from the line.
    opened = F.when(opened & F.col("starts"), _fail(" in a quoted text", F.col("text"), "boolean")).otherwise(opened)
    return lines.select(*_SPLIT, "line", "text", "starts", "block", opened.alias("opened"))


def _fragments(lines: DataFrame, specs: Mapping[str, TableSpec], folder: str) -> DataFrame:
    """SQL lines cut behind each ``)`` and ``;`` outside quotes: ``fragment``, ``done`` if it ends so, and its statement."""
    whole = F.when(F.col("opened"), F.concat(F.lit("'"), "text")).otherwise(F.col("text"))
    whole = F.when(whole.contains(_CUT), _fail(", character", whole)).otherwise(F.regexp_replace(whole, _COMMENT, "$1"))

    def cut(part: Column) -> Column:
        for mark in ");":
            part = F.replace(part, F.lit(mark), F.lit(mark + _CUT))
        return part

    marked = _outside_quotes(whole, cut)
    marked = F.when(F.col("opened"), F.substr(marked, F.lit(2))).otherwise(marked)
    rows = lines.where(F.col("block.table_name").isNull() & (~F.col("starts") | F.col("opened")))
    rows = rows.withColumn("parts", F.split(marked, _CUT)).select(
        *_SPLIT, "line", "opened", F.size("parts").alias("n"), F.posexplode("parts").alias("place", "fragment")
    )
    text = F.col("fragment")
    rows = rows.withColumn("done", F.col("place") < F.col("n") - 1)
    begins = ~(F.col("opened") & (F.col("place") == 0)) & text.rlike(_INSERT_LIKE)
    header = F.when(text.rlike(_INSERT), _target(text, _INSERT, specs)).otherwise(_fail("", text, _NONE))
    none = F.struct(F.lit(None).cast("string").alias("table_name"), F.lit(None).cast("array<string>").alias("columns"))
    rows = rows.withColumn("header", F.when(begins, header))
    event = F.when(F.col("done") & text.endswith(";"), none).otherwise(F.col("header"))
    before, _ = _in_order("line", "place")
    rows = rows.withColumn("event", event)
    pending = F.when(F.col("done"), False).when(F.trim(F.regexp_replace("fragment", r"\s+", " ")) != "", True)
    rows = rows.withColumn("local", F.last("event", True).over(before))
    rows = rows.withColumn("pending", F.last(pending, True).over(before))
    rows = rows.withColumn("number", F.coalesce(F.sum(F.col("done").cast("long")).over(before), F.lit(0)))
    rows = _stage(rows.drop("n", "opened"), folder)
    splits = rows.groupBy(*_SPLIT).agg(
        F.sum(F.col("done").cast("long")).alias("n_done"),
        F.max_by("event", F.when(F.col("event").isNotNull(), F.struct("line", "place"))).alias("event"),
    )
    earlier, _ = _in_order("split", by=("file",))
    unended = F.last("event", True).over(_whole("split"))["table_name"].isNotNull()
    carried = F.last("event", True).over(earlier)
    splits = splits.select(
        *_SPLIT,
        F.coalesce(F.sum("n_done").over(earlier), F.lit(0)).alias("numbers"),
        F.when(unended, _fail(", the file ends in a statement", F.col("file"), _NONE)).otherwise(carried).alias("carried"),
    )
    rows = rows.join(splits, list(_SPLIT))
    rows = rows.withColumn("statement", F.coalesce("header", "local", "carried"))
    return rows.where("statement.table_name is not null").select(
        *_SPLIT, "line", "place", "fragment", "done", "pending", (F.col("number") + F.col("numbers")).alias("number"), "statement"
    )


def _inserted(fragments: DataFrame) -> DataFrame:
    """``table_name, columns, values`` of the rows in INSERT statements; NULL where the text says so."""
    # A row on one line is there as a whole; the others are put together. Blank ends of lines belong to no row.
    alone = F.col("done") & ~F.coalesce("pending", F.lit(True))
    blank = ~F.col("done") & ~F.coalesce("pending", F.lit(True)) & ~F.col("fragment").rlike(r"\S")
    single = fragments.where(alone).select("statement", F.col("fragment").alias("text"))
    parts = fragments.where(~alone & ~blank).groupBy("file", "number").agg(
        F.sort_array(F.collect_list(F.struct("split", "line", "place", "fragment", "statement"))).alias("parts")
    )
    joined = parts.select(F.col("parts")[0]["statement"].alias("statement"), F.array_join("parts.fragment", "\n").alias("text"))
    whole = single.unionByName(joined)
    text = F.col("text")
    left = text.rlike(_END) | text.rlike(_COLUMNS_ONLY) | ~text.rlike(r"\S")
    content = F.when(text.rlike(_ROW), F.regexp_extract(text, _ROW, 1)).otherwise(_fail("", text))
    cells = F.split(_outside_quotes(content, lambda part: F.replace(part, F.lit(","), F.lit(_CUT))), _CUT)

    def value(cell: Column) -> Column:
        cell = F.regexp_replace(cell, r"^\s+|\s+\z", "")
        inner = F.substr(cell, F.lit(2), F.greatest(F.length(cell) - 2, F.lit(0)))
        quoted = cell.startswith("'") & cell.endswith("'") & (F.length(cell) > 1)
        quoted &= ~F.replace(inner, F.lit("''"), F.lit("")).contains("'")
        return (
            F.when(quoted, F.replace(inner, F.lit("''"), F.lit("'")))
            .when(F.upper(cell) == "NULL", None)
            .when(cell.rlike(r"^[^\s'()]+\z"), cell)
            .otherwise(_fail(", value", cell))
        )

    return whole.where(~left).select("statement.table_name", "statement.columns", F.transform(cells, value).alias("values"))


def _rows(spark: SparkSession, path: str, specs: Mapping[str, TableSpec], folder: str) -> DataFrame:
    """``columns, values, table_name`` of every row in the dump, written to ``folder`` by table; columns null: as declared."""
    lines = _quotes(_read(spark, path, specs), f"{folder}/lines")
    rows = _inserted(_fragments(lines, specs, f"{folder}/fragments")).unionByName(_copied(lines))
    rows.write.mode("overwrite").partitionBy("table_name").parquet(f"{folder}/rows")
    return spark.read.schema("columns array<string>, values array<string>, table_name string").parquet(f"{folder}/rows")


def _value(text: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.BinaryType):
        return F.unhex(F.regexp_replace(text, r"^\\x", ""))
    return text.cast(kind)


def _typed(rows: DataFrame, spec: TableSpec) -> DataFrame:
    """Cast values by place; a wrong number of values or an unknown column fails the job."""
    fields = spec.schema.fields
    names = [f.name.lower() for f in fields]
    columns = F.coalesce("columns", F.array(*map(F.lit, names)))
    rows = rows.filter(F.col("table_name") == spec.name.lower()).select(columns.alias("columns"), "values")
    fits = (F.size("columns") == F.size("values")) & (F.size(F.array_except("columns", F.array(*map(F.lit, names)))) == 0)
    checked = F.when(fits, F.col("values")).otherwise(
        F.raise_error(F.lit(f"{spec.name}: expected {len(fields)} values, or one for each listed column")).cast("array<string>")
    )
    rows = rows.select("columns", checked.alias("values"))
    return rows.select(
        *[
            _value(F.get("values", F.array_position("columns", F.lit(name)).cast("int") - 1), f.dataType).alias(f.name)
            for name, f in zip(names, fields, strict=True)
        ]
    )


def read_dump(
    spark: SparkSession, path: str, specs: Mapping[str, TableSpec] = RETAIL
) -> dict[str, DataFrame]:
    """Typed DataFrames of a dump. Its text is parsed here, once, into the scratch folder; tables are cast when used."""
    rows = _rows(spark, path, specs, scratch_path(spark, "dump"))
    return {name: _typed(rows, spec) for name, spec in specs.items()}


def convert_dump(
    spark: SparkSession, path: str, root: str, specs: Mapping[str, TableSpec] = RETAIL
) -> dict[str, int]:
    """Convert a large dump to one Parquet folder per table, ``root/<name>``; rows loaded by table.

    The text is parsed once into a copy partitioned by table; each table then
    reads only its own partition. The copy goes when the tables are written.
    """
    staged = f"{root}/_statements"
    rows = _rows(spark, path, specs, staged)
    for name, spec in specs.items():
        _typed(rows, spec).write.mode("overwrite").parquet(f"{root}/{name}")
    loaded = {name: spark.read.schema(spec.schema).parquet(f"{root}/{name}").count() for name, spec in specs.items()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return loaded
