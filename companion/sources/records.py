"""Line records written as Python literals (S1), read without ``eval``.

The raw files are gzipped text, one Python ``dict`` literal per line: single- or
double-quoted strings, ``None`` / ``True`` / ``False``.  They are read as text
(Spark decompresses ``.gz`` per file); a line is cut into quoted strings and the
rest, bare literals are rewritten to JSON in the rest only, and ``from_json``
parses the line with single quotes allowed against an explicit schema.

Lines that still do not parse are never dropped silently: ``split_records`` keeps
them beside the records, ``record_counts`` counts both, and ``strict`` reading
stops on the first file that has any.

A schema is open where a struct level has a VARIANT field ``rest``: it receives every key
of that level that no other field names, as one object (null where there is none), and
``to_literal_lines`` spreads it back over the level it came from.  Of a key that a top
level repeats, the last value counts, as in Python; a line that VARIANT cannot hold (keys
repeated deeper inside ``rest``) counts as one that cannot be parsed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from companion.schemas import REST
from companion.session import materialize, total_bytes

OBJECT = "map<string,variant>"
CORE_PARTS = 2                # parts of a core at least, so that uneven ones even out
PART_BYTES = 1 << 25          # bytes (of gzip or plain text) that are parsed as one part

# A line's pieces: a quoted string (escapes included), a stretch without quotes, or a
# quote that is never closed.
_PIECE = r"""'(?:[^'\\]++|\\.)*+'|"(?:[^"\\]++|\\.)*+"|[^'"]++|['"]"""
# Bare Python literals and their JSON form.
_LITERALS = (("None", "null"), ("True", "true"), ("False", "false"))
_HEX_ESCAPE = r"(?<!\\)((?:\\\\)*)\\x([0-9a-fA-F]{2})"

_PARSE_OPTIONS = {
    "allowSingleQuotes": "true",
    "allowBackslashEscapingAnyCharacter": "true",
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": "_corrupt",
}


def _outside_strings(line: F.Column, bare, quoted=lambda piece: piece) -> F.Column:
    """``line`` with ``bare`` applied outside quoted strings and ``quoted`` to them."""
    pieces = F.regexp_extract_all(line, F.lit(_PIECE), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(
        p.startswith("'") | p.startswith('"'), quoted(p)).otherwise(bare(p))), "")


def normalize_literals(line: F.Column) -> F.Column:
    """Rewrite bare ``None``/``True``/``False`` to JSON, and ``\\xhh`` escapes inside strings."""
    def bare(piece):
        for py, js in _LITERALS:
            piece = F.regexp_replace(piece, rf"\b{py}\b", js)
        return piece

    cut = _outside_strings(
        line, bare, lambda piece: F.regexp_replace(piece, _HEX_ESCAPE, r"$1\\u00$2"))
    # most lines hold neither a literal word nor such an escape: they stay whole
    return F.when(line.rlike(r"\b(?:None|True|False)\b|\\x"), cut).otherwise(line)


def is_open(schema: T.DataType) -> bool:
    """Whether a struct keeps, at some level, the keys that it does not name."""
    return isinstance(schema, T.StructType) and any(
        (f.name == REST and isinstance(f.dataType, T.VariantType)) or is_open(f.dataType)
        for f in schema.fields)


def _named(schema: T.StructType) -> list[T.StructField]:
    return [f for f in schema.fields
            if not (f.name == REST and isinstance(f.dataType, T.VariantType))]


def _closed(schema: T.DataType) -> T.DataType:
    """``schema`` without its ``rest`` fields."""
    if not is_open(schema):
        return schema
    return T.StructType([T.StructField(f.name, _closed(f.dataType)) for f in _named(schema)])


def _last_values(entries: F.Column) -> F.Column:
    """A parsed map with the last value of every key.  The map is bound as a variable: inside
    the filter its expression would be parsed again for every key."""
    def last(parsed):
        return F.transform(F.array(F.map_keys(parsed)), lambda keys: F.map_from_entries(F.filter(
            F.map_entries(parsed), lambda e, i: ~F.array_contains(
                F.slice(keys, i + 2, F.size(keys)), e["key"]))))[0]

    return F.transform(F.array(entries), last)[0]


def _with_rest(typed: F.Column, whole: F.Column, schema: T.StructType) -> list[F.Column]:
    """The fields of an open struct: parsed ones from ``typed``, the others from ``whole``."""
    names = [f.name for f in _named(schema)]
    out = []
    for field in schema.fields:
        if field.name not in names:
            others = F.map_filter(whole, lambda key, _: ~key.isin(*names))
            value = F.when(F.size(others) > 0, F.to_variant_object(others))
        elif is_open(field.dataType):
            inner = F.try_variant_get(F.element_at(whole, F.lit(field.name)), "$", OBJECT)
            value = F.when(typed[field.name].isNotNull(), F.struct(
                *_with_rest(typed[field.name], inner, field.dataType)))
        else:
            value = typed[field.name]
        out.append(value.alias(field.name))
    return out


def parse_records(lines: DataFrame, schema: T.StructType,
                  column: str = "value") -> DataFrame:
    """Parse a text column into ``schema`` plus ``_corrupt`` (the raw line of
    rows that failed to parse, else null)."""
    with_corrupt = T.StructType(
        _closed(schema).fields + [T.StructField("_corrupt", T.StringType())])
    text = normalize_literals(F.col(column))
    rows = lines.where(F.trim(F.col(column)) != "").select(
        F.from_json(text, with_corrupt, _PARSE_OPTIONS).alias("_r"), F.col(column).alias("_line"),
        *([_last_values(F.from_json(text, OBJECT, _PARSE_OPTIONS)).alias("_whole")]
          if is_open(schema) else []))
    broken = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    fields = [F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields
              if not is_open(schema)]
    if is_open(schema):
        broken |= F.col("_whole").isNull()
        fields = _with_rest(F.col("_r"), F.col("_whole"), schema)
    return rows.select(*fields, F.when(broken, F.col("_line")).alias("_corrupt"))


def split_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Every non-blank line of Python-literal line files (gz or plain) as ``schema`` plus
    ``_corrupt``.  Gzip files are not splittable: the lines are spread over partitions
    before they are parsed, about ``PART_BYTES`` of the files in each and enough of them for
    every core.  Parsing costs far more than a line's bytes tell, so they aren't merged."""
    size = total_bytes(spark, path)
    parts = max(CORE_PARTS * spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    return parse_records(spark.read.text(path).repartition(parts), schema)


def record_counts(parsed: DataFrame) -> DataFrame:
    """One row: ``n_records``, ``n_corrupt`` of ``split_records``."""
    return parsed.agg(F.count_if(F.col("_corrupt").isNull()).cast("long").alias("n_records"),
                      F.count_if(F.col("_corrupt").isNotNull()).cast("long").alias("n_corrupt"))


def read_records(spark: SparkSession, path: str, schema: T.StructType,
                 strict: bool = True) -> DataFrame:
    """Records of ``schema``.  A line that cannot be parsed is an error; without
    ``strict`` such lines are left to ``corrupt_records``."""
    parsed = split_records(spark, path, schema)
    if strict:
        parsed = materialize(parsed, "records")
        require_clean(parsed, path)
    return parsed.where(F.col("_corrupt").isNull()).drop("_corrupt")


def require_clean(parsed: DataFrame, path: str) -> None:
    bad = record_counts(parsed).first().n_corrupt
    if bad:
        raise ValueError(f"{path}: {bad} lines cannot be parsed")


def corrupt_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Lines that could not be parsed, with their text."""
    return split_records(spark, path, schema).where(
        F.col("_corrupt").isNotNull()).select(F.col("_corrupt").alias("line"))


def key_counts(df: DataFrame, column: str = REST) -> DataFrame:
    """``key, n_records`` over the objects of a VARIANT column: what a schema leaves out."""
    return (df.select(F.explode(F.map_keys(F.try_variant_get(F.col(column), "$", OBJECT))).alias("key"))
            .groupBy("key").agg(F.count("*").alias("n_records")))


def _whole_object(fields: dict[str, F.Column], schema: T.StructType) -> F.Column:
    """One VARIANT object of an open level: its named fields and the keys of ``rest``."""
    named = _named(schema)
    values = [F.when(fields[f.name].isNotNull(), _whole_object(
        {g.name: fields[f.name][g.name] for g in f.dataType.fields}, f.dataType))
        if is_open(f.dataType) else fields[f.name] for f in named]
    known = F.to_variant_object(F.struct(*[v.alias(f.name) for v, f in zip(values, named)]))
    if len(named) == len(schema.fields):
        return known
    others = F.coalesce(F.try_variant_get(fields[REST], "$", OBJECT), F.create_map().cast(OBJECT))
    return F.to_variant_object(F.map_concat(known.cast(OBJECT), F.map_filter(
        others, lambda key, _: ~key.isin(*[f.name for f in named]))))


def to_literal_lines(df: DataFrame) -> DataFrame:
    """One Python-literal line per row (``value`` column): single-quoted strings with
    ``'`` and ``\\`` escaped, and ``None`` for null fields.  The keys of ``rest`` stand
    beside the named ones of their level, which win where both hold one."""
    js = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    if is_open(df.schema):
        js = F.to_json(_whole_object({c: F.col(c) for c in df.columns}, df.schema))

    def bare(piece):
        for py, literal in _LITERALS:
            piece = F.regexp_replace(piece, rf"\b{literal}\b", py)
        return piece

    def quoted(piece):
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        inner = F.regexp_replace(inner, r'(?<!\\)((?:\\\\)*)\\"', '$1"')
        return F.concat(F.lit("'"), F.replace(inner, F.lit("'"), F.lit("\\'")), F.lit("'"))

    # without escapes, apostrophes and literal words only the quotes differ
    plain = F.translate(js, '"', "'")
    return df.select(F.when(js.rlike(r"['\\]|\b(?:null|true|false)\b"), _outside_strings(
        js, bare, quoted)).otherwise(plain).alias("value"))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain read of a table, dealt over all cores if its files make fewer tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(CORE_PARTS * cores)


def write_records(df: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write ``df`` as gzipped Python-literal line records."""
    to_literal_lines(df).write.text(path, compression=compression)
