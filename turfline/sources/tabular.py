"""Tolerant readers and dynamic-column writers for delimited files.

Files are read one by one and united by name, because one read over files whose headers
differ in order misplaces columns. What reaches the driver is the first line of a file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import name_key, strip
from ..staging import stage

DELIMITERS = (";", ",", "\t", "|")
#: Header spellings per logical column of a history file; a parameter.
ALIASES = {
    "id": ["id"],
    "ts": ["ts", "date", "timestamp", "horodatage"],
    "horse": ["horse", "cheval", "nom cheval"],
    "rider": ["rider", "cavalier", "jockey"],
    "family": ["family", "discipline"],
    "height": ["height", "hauteur"],
    "level": ["level", "niveau"],
    "proba": ["proba", "probability", "score"],
    "cold_start": ["cold_start", "is_cold_start", "cold start"],
}
TRUE_TEXTS = ("1", "true", "yes", "oui", "vrai", "y")


def first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The header of a text file; a BOM is dropped."""
    head = spark.read.option("encoding", encoding).option("sep", "\x01").option("quote", "").csv(path).limit(1).collect()
    return (head[0][0] or "").lstrip("\ufeff") if head else ""


def sniff(line: str) -> str:
    """The delimiter that occurs most often in a header."""
    return max(DELIMITERS, key=lambda d: (line.count(d), -DELIMITERS.index(d)))


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", separator: str | None = None) -> DataFrame:
    """One file, all columns as text; the delimiter is found from the header."""
    separator = separator or sniff(first_line(spark, path, encoding))
    return spark.read.option("header", True).option("sep", separator).option("encoding", encoding).option("multiLine", False).csv(path)


def read_serving(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """A feature table for lookups: a CSV with a key beside each name, which spelling of case and blanks doesn't change: {column: key}."""
    rows = read_csv(spark, path)
    return rows.withColumns({key: name_key(F.col(f"`{c}`")) for c, key in names.items()})


def resolve(header: list[str], aliases: dict[str, list[str]] = ALIASES) -> dict[str, str]:
    """logical column -> column of the file, spelling and case aside."""
    seen = {strip_text(h): h for h in header}
    return {name: next(seen[a] for a in names if a in seen) for name, names in aliases.items() if any(a in seen for a in names)}


def strip_text(x: str) -> str:
    return x.strip().lower()


def found_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 if the file holds NUL bytes, UTF-8 if all its lines are valid, else ISO-8859-1, which stands for windows-1252.

    text() keeps the bytes as they are.
    """
    lines = spark.read.text(path)
    has_nul, broken = lines.agg(F.bool_or(F.contains("value", F.lit("\0"))), F.bool_or(~F.is_valid_utf8("value"))).first()
    return "UTF-16" if has_nul else "ISO-8859-1" if broken else "UTF-8"


#: The signs of windows-1252 where Latin-1 has control characters, U+0080 to U+009F; five stay undefined.
WINDOWS_SIGNS = "\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178"
_LATIN_CONTROLS = "".join(chr(c) for c in range(0x80, 0xA0))


def as_windows_text(rows: DataFrame) -> DataFrame:
    """Text columns and headers read as Latin-1, as windows-1252 has them: Spark decodes no such files, but Latin-1 keeps every byte apart."""
    signs = str.maketrans(_LATIN_CONTROLS, WINDOWS_SIGNS)
    return rows.select(*[F.translate(F.col(f"`{c}`"), _LATIN_CONTROLS, WINDOWS_SIGNS).alias(c.translate(signs)) for c in rows.columns])


def read_history_file(spark: SparkSession, path: str, aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """A history file in any of the known encodings, delimiters and header spellings; absent columns are null."""
    encoding = found_encoding(spark, path)
    rows = read_csv(spark, path, encoding)
    rows = as_windows_text(rows) if encoding == "ISO-8859-1" else rows
    known = resolve(rows.columns, aliases)
    columns = [F.col(f"`{known[n]}`").alias(n) if n in known else F.lit(None).cast("string").alias(n) for n in aliases]
    rows = rows.select(*columns, F.lit(path.rsplit("/", 1)[-1]).alias("file"), F.monotonically_increasing_id().alias("line"))
    return rows.where((strip(F.col("horse")) != "") & (strip(F.col("family")) != ""))


def truth(x: Column) -> Column:
    return F.coalesce(F.lower(strip(x)).isin(*TRUE_TEXTS), F.lit(False))


def read_directory(spark: SparkSession, paths: list[str], aliases: dict[str, list[str]] = ALIASES) -> DataFrame:
    """All files as one table with provenance; of rows with one id the first file's first line stays.

    Rows without an id get a digest of their content, so that reading twice agrees.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_history_file(spark, p, aliases) for p in sorted(paths)])
    content = F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c not in ("id", "file", "line")])), 256)
    rows = rows.withColumn("id", F.coalesce(F.nullif(strip(F.col("id")), F.lit("")), content))
    w = Window.partitionBy("id").orderBy("file", "line")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a declared schema; malformed lines and unknown keys are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_metadata(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, the corrupt ones left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", True).json(path)
    # Spark won't tell corrupt records where nothing else is read, so the sound ones are staged.
    return stage(rows.where("_corrupt_record IS NULL"), "metadata").drop("_corrupt_record")


def normalised_header(names: list[str]) -> list[str]:
    """Trimmed, lower case, spaces to underscores, other characters dropped; collisions are an error."""
    out = ["".join(c for c in n.strip().lower().replace(" ", "_") if c in "abcdefghijklmnopqrstuvwxyz0123456789_") for n in names]
    if len(set(out)) != len(out):
        raise ValueError(f"headers collide: {out}")
    return out


def dynamic_columns(rows: DataFrame, attributes: str, position: str, priority: list[str]) -> list[str]:
    """Keys of a map column: the priority ones first, then by first appearance. One row per key reaches the driver."""
    keys = rows.select(position, F.explode(F.map_keys(attributes)).alias("k")).groupBy("k").agg(F.min(position).alias("p")).orderBy("p", "k")
    found = [r["k"] for r in keys.collect()]
    return [k for k in priority if k in found] + [k for k in found if k not in priority]


def spread(rows: DataFrame, attributes: str, position: str, priority: list[str]) -> DataFrame:
    """The map as columns; blanks become 0 in columns whose other values are all numbers, else NONE."""
    columns = dynamic_columns(rows, attributes, position, priority)
    wide = rows.select(position, *[F.col(attributes)[k].alias(k) for k in columns])
    blank = lambda k: F.coalesce(strip(F.col(f"`{k}`")) == "", F.lit(True))
    number = lambda k: strip(F.col(f"`{k}`")).rlike(r"^-?\d+(?:\.\d+)?$")
    tests = [(F.bool_and(blank(k) | number(k)) & (F.count_if(~blank(k)) > 0)).alias(f"{i}") for i, k in enumerate(columns)]
    numeric = wide.agg(*tests).first() if columns else []
    fill = {k: F.when(blank(k), F.lit("0" if numeric[i] else "NONE")).otherwise(F.col(f"`{k}`")) for i, k in enumerate(columns)}
    return wide.select(position, *[fill[k].alias(k) for k in columns])


def write_step(rows: DataFrame, path: str, meta: list[str]) -> None:
    """A step's table as CSV: meta columns dropped, and rows that are blank throughout."""
    kept = rows.drop(*meta)
    some = reduce(lambda a, b: a | b, [F.coalesce(strip(F.col(f"`{c}`").cast("string")) != "", F.lit(False)) for c in kept.columns])
    kept.where(some).write.mode("overwrite").option("header", True).csv(path)


#: Values of the invented participations and their shares; parameters of the generator.
SHARES = {
    "sex": (("F", 0.45), ("H", 0.40), ("M", 0.15)),
    "breed": (("SF", 0.30), ("PFS", 0.20), ("AA", 0.15), ("CO", 0.10), ("ONC", 0.15), ("KWPN", 0.10)),
    "family": (("CSO", 0.40), ("Dressage", 0.25), ("Hunter", 0.15), ("CCE", 0.10), ("Endurance", 0.10)),
    "level": (("Club", 0.35), ("Amateur", 0.30), ("Regional", 0.20), ("National", 0.10), ("International", 0.05)),
    "category": (("Amateur", 0.50), ("Junior", 0.20), ("Pro", 0.20), ("Senior", 0.10)),
}
CLUBS = 12
MISSING_SHARE = 0.05


def generate(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """Invented participations of 19 columns, pos beside them: a result that follows rates, age, experience and level, with noise and five per cent nulls in three columns.

    Every draw is a hash of seed, draw and row, so rows don't depend on partitions. A beta(2, 3) variate is the second
    smallest of four uniform ones, a normal one comes from two (Box-Muller).
    """
    uniform = lambda draw: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), "pos"), 11) + 0.5) / F.lit(float(1 << 53))
    whole = lambda draw, low, high: (F.floor(uniform(draw) * F.lit(high - low)) + low).cast("int")
    beta = lambda draw: F.least(F.lit(0.95), F.greatest(F.lit(0.05), F.sort_array(F.array(*[uniform(f"{draw}{i}") for i in range(4)]))[1]))
    normal = F.sqrt(-2 * F.log(uniform("normal"))) * F.cos(2 * F.pi() * uniform("angle"))

    def pick(name: str) -> Column:
        at, cases, below = uniform(name), F.lit(None), 0.0
        for i, (value, share) in enumerate(SHARES[name]):
            below += share
            cases = F.when(at < below, value) if i == 0 else cases.when(at < below, value) if i + 1 < len(SHARES[name]) else cases.otherwise(value)
        return cases

    level = F.element_at(F.create_map(*[F.lit(x) for i, (v, _) in enumerate(SHARES["level"]) for x in (v, i + 1)]), F.col("level"))
    rows = spark.range(n).withColumnRenamed("id", "pos").select(
        "pos",
        whole("horse", 1, max(2, int(n * 0.4))).alias("horse_id"),
        whole("rider", 1, max(2, int(n * 0.3))).alias("rider_id"),
        whole("horse_age", 3, 22).alias("horse_age"),
        pick("sex").alias("sex"),
        pick("breed").alias("breed"),
        whole("rider_age", 10, 65).alias("rider_age"),
        pick("category").alias("category"),
        F.format_string("Club_%02d", whole("club", 1, CLUBS + 1)).alias("club"),
        pick("family").alias("family"),
        pick("level").alias("level"),
        whole("starters", 5, 100).alias("starters"),
        whole("horse_starts", 0, 200).alias("horse_starts"),
        whole("rider_starts", 0, 300).alias("rider_starts"),
        beta("horse_rate").alias("horse_rate"),
        beta("rider_rate").alias("rider_rate"),
        normal.alias("_noise"),
    )
    prime = 1 - F.abs(F.col("horse_age") - 10) / 15
    experience = F.least(F.col("horse_starts") / 100, F.lit(1.0))
    score = 0.30 * F.col("horse_rate") + 0.25 * F.col("rider_rate") + 0.15 * prime + 0.15 * experience + 0.15 / level + 0.08 * F.col("_noise")
    rows = rows.withColumn("_score", score)
    rank = F.greatest(F.lit(1), (F.col("starters") * (1 - F.col("_score")) + whole("place", -3, 4)).cast("int"))
    blank = lambda name, x: F.when(uniform(f"missing {name}") >= MISSING_SHARE, x).alias(name)
    return rows.select(
        "pos", "horse_id", "rider_id", F.format_string("Cheval_%04d", "horse_id").alias("horse"), F.format_string("Cavalier_%04d", "rider_id").alias("rider"), "horse_age", "sex",
        blank("breed", F.col("breed")), blank("rider_age", F.col("rider_age")), "category", "club", "family", "level", "starters", "horse_starts", "rider_starts",
        blank("horse_rate", F.round("horse_rate", 3)), F.round("rider_rate", 3).alias("rider_rate"), F.least(rank, F.col("starters")).alias("rk"),
        (F.col("_score") > 0.38 + 0.17 * uniform("bar")).cast("int").alias("won"),
    )
