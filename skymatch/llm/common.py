"""What several operators share: word expressions, scratch tables and the hold-out rule."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the contracts: what separates words, as a class of a regular expression.
SPACE = r"\x20\x09-\x0D"
#: Folders of scratch tables that release() deletes.
SCRATCH: list[str] = []


def words(text: Column) -> Column:
    """Array of the words of a text; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long, without building the words: one marker for each run of them."""
    return F.coalesce(F.length(F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]+", "x"), f"[{SPACE}]+", "")), F.lit(0)).cast("long")


def bind(value: Column, body) -> Column:
    """body(value) with value computed once for each row, though body uses it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no model may learn from. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors see; a local folder only where that setting is empty, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder for a table that release() deletes."""
    SCRATCH.append(f"{shared_dir(spark)}/skymatch-{uuid.uuid4().hex}")
    return SCRATCH[-1]


def model_dir(spark: SparkSession) -> str:
    """Where fitted models stay, under names made of what they were fitted to."""
    return f"{shared_dir(spark)}/skymatch-models"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lost executors don't repeat what came before."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Sample:
    """What a classifier learns from. rows: labelled documents at most, whole texts all of them; once there are more, the rarer class gets up to least_share of the rows, and weights give each class its share of all labels back."""

    rows: int
    least_share: float = 0.4


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, how: Sample, key: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _y (0 or 1), _weight, _text of labelled documents that aren't held out, in the order of a hash of the id: at most how.rows ids, all rows of each.

    The sample doesn't depend on the layout. Only the chosen ids are sent to the scan; texts stay with the executors.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).cast("long").alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    rarer = min((0, 1), key=lambda y: (n.get(y, 0), y))
    take = {rarer: min(n.get(rarer, 0), how.rows if sum(n.values()) <= how.rows else int(how.rows * how.least_share))}
    take[1 - rarer] = min(n.get(1 - rarer, 0), how.rows - take[rarer])
    order = F.md5(F.col("_id").cast("string").cast("binary"))
    ids = [(r["_id"], y, n[y] / take[y]) for y in (0, 1) if take[y] for r in known.where(F.col("_y") == y).orderBy(order, "_id").limit(take[y]).collect()]
    chosen = docs.sparkSession.createDataFrame(ids, "_id long, _y int, _weight double")
    return docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")  # at most how.rows ids


def release(spark: SparkSession) -> int:
    """Deletes the scratch tables that this process has made; results that still read them must be written before. Returns how many there were."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while SCRATCH:
        path = spark._jvm.org.apache.hadoop.fs.Path(SCRATCH.pop())
        n += path.getFileSystem(hadoop).delete(path, True)
    return n


def boxed(df: DataFrame) -> Column:
    """All columns as one struct, so that no name of theirs can meet one that an operator makes."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def unboxed(columns: list[str], **made: Column) -> list[Column]:
    """The columns out of the struct, those in `made` replaced or added."""
    return [*(F.col("_row").getField(c).alias(c) for c in columns if c not in made), *(v.alias(k) for k, v in made.items())]


def row_hash(df: DataFrame, text: str = "text") -> Column:
    """64 bits of a whole row, to tell rows apart that share an id and a text. Maps, which have no hash, count by their JSON."""

    def hashed(f) -> Column:
        c = F.col(f"`{f.name}`")
        return F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else F.xxhash64(c) if f.name == text else c

    return F.xxhash64(*(hashed(f) for f in df.schema))


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores if a column of df has it."""
    while name in df.columns:
        name += "_"
    return name
