"""Personal data: rules find the base spans, a character model adds spans that the rules miss.

The model (pii_model) is a bidirectional LSTM over characters whose outputs feed a CRF over begin/inside tags of four kinds, all in numpy. It learns from
labelled spans: windows of a bounded sample of documents, labelled by the rules, and made-up mentions of each kind in many notations, set into
clean windows of these documents, with look-alikes that are no personal data (pii_mentions). Whole texts are read twice over, from coarse to fine: a tagger of groups of four characters
reads every character, in windows that overlap, and a tagger of single characters decides wherever the coarse one sees a mention with a probability of 1% (`suspicion`; 0 lets the fine one read
everything). The model's own gate, a table of character triples learnt from the same windows, asks for further windows around what it marks; it leaves nothing out. A span that reaches the end of its window is decoded
again in one twice as long, so mentions have no greatest length. A span weighs its least tag marginal times its length; of all windows' spans of a text the
compatible set of greatest weight is kept, base spans going first. No pattern stands between the model and its spans; only what defines a kind is
asked of them: an ip has four numbers up to 255, a card 14 to 19 digits that pass Luhn's check, a phone 9 to 15 digits, and none begins or ends inside a word or number.

The fitted model is stored in the shared folder under a name made of its sample and settings, and loaded where it is there already. It is fitted in a task, not on the driver.

Nulls and empties: a null text is empty and has no spans. Repeated rows are searched alike. An empty table gives an empty result. Other columns are
ignored, so their names can't clash. Texts have no greatest length: rules and windows take time in proportion to it. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import model_dir
from .pii_mentions import lookalikes, luhn, made_up
from .pii_model import KINDS, WINDOW, Gate, Span, Tagger, char_ids, learn_gate, packed, train, unpacked

# ---- rules

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match begins at the start of a run of digits, since all of a run's suffixes fail or succeed with it
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+(?<=[0-9])")
_DIGIT = re.compile("[0-9]")


def emails(text: str) -> list[Span]:
    """From each `@` to the left as far as local parts go, and on to the right: what a search from the left finds, without its retries."""
    out: list[Span] = []
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, end := m.end(), "email"))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[Span]:
    """Spans of the rules, by start and kind."""
    out = emails(text) if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if len(m[0]) >= 3 and 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out, key=order)


def order(s: Span) -> tuple[int, int, int]:
    return s[0], KINDS.index(s[2]), s[1]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=order))


# ---- windows

STRIDE, AROUND = 64, 40
#: Characters of a window of the scan over whole texts, and how many of them the next one has, too.
WIDE, OVERLAP = 1536, 96


def scan(size: int) -> list[tuple[int, int]]:
    """Windows (start, end) over all characters of a text."""
    return [(s, min(size, s + WIDE)) for s in range(0, max(min(size, 1), size - OVERLAP), WIDE - OVERLAP)]


def windows(text: str, hits: np.ndarray, reach: int) -> list[tuple[int, int]]:
    """Windows (start, end) over all stretches of AROUND characters before and after the hits, which are reach long. They overlap by WINDOW - STRIDE."""
    out: list[tuple[int, int]] = []
    if not len(hits):
        return out
    cuts = np.flatnonzero(np.diff(hits) > 2 * AROUND + reach) + 1
    for part in np.split(hits, cuts):
        a, b = max(0, int(part[0]) - AROUND), min(len(text), int(part[-1]) + reach + AROUND)
        out += [(s, min(len(text), s + WINDOW)) for s in range(a, max(a + 1, b - (WINDOW - STRIDE)), STRIDE)]
    return out


@dataclass(frozen=True)
class Learning:
    """docs: documents of the sample that hold digits or @, and a third as many others. labelled: at most so many of their windows. generated: made-up ones. A model's name depends on all of these and the sample."""

    docs: int = 600
    labelled: int = 900
    clean: int = 900
    generated: int = 6500
    epochs: int = 7
    seed: int = 5


def labelled_windows(text: str) -> Iterator[tuple[str, list[Span]]]:
    """Windows around base spans, and in between, that cut no base span. Spans that overlap are left out with their windows."""
    spans = base_spans(text)
    starts = [max(0, (a + b) // 2 - WINDOW // 2) for a, b, _ in spans] + list(range(0, len(text), 4 * WINDOW))
    for start in starts:
        end = start + WINDOW
        inside = [s for s in spans if s[0] >= start and s[1] <= end]
        if len(inside) == sum(s[0] < end and s[1] > start for s in spans) and all(a[1] <= b[0] for a, b in zip(inside, inside[1:])):
            yield text[start:end], [(a - start, b - start, k) for a, b, k in inside]


def fit(sample: list[tuple[str, list[Span]]], how: Learning = Learning()) -> tuple[Gate, Tagger]:
    """The model from labelled windows and made-up mentions in those without spans."""
    clean = [t for t, s in sample if not s and len(t) > 20 and not re.search("[0-9@]", t)] or ["the words around a mention of somebody or other, and those that follow it, say little "]
    rows = sample + made_up(clean, how.generated, random.Random(how.seed)) + lookalikes(clean, how.generated // 4, random.Random(how.seed + 1))
    model = train(rows, epochs=how.epochs, seed=how.seed)
    model.coarse = train(rows, epochs=how.epochs, seed=how.seed, h=16, step=4)
    return learn_gate(rows), model


def valid(text: str, a: int, b: int, kind: str) -> bool:
    """Whether a span meets what defines its kind."""
    if (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()):
        return False
    numbers = re.findall("[0-9]+", text[a:b])
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) < 4 and int(x) <= 255 for x in numbers)
    digits = "".join(numbers)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def reconciled(spans: list[tuple[int, int, str, float]]) -> list[Span]:
    """The compatible spans of greatest weight in all. Of equal ones the earlier ending win."""
    spans = sorted(set(spans), key=lambda s: (s[1], s[0]))
    best: list[tuple[float, tuple | None]] = [(0.0, None)]
    ends = [s[1] for s in spans]
    for i, (a, _, _, weight) in enumerate(spans):
        before = int(np.searchsorted(ends, a, side="right"))
        take = best[min(before, i)][0] + weight
        best.append((take, (i, min(before, i))) if take > best[i][0] else (best[i][0], None))
    out, i = [], len(spans)
    while i:
        if best[i][1] is None:
            i -= 1
        else:
            j, i = best[i][1]
            out.append(spans[j][:3])
    return out[::-1]


def batches_of(jobs: list[tuple[int, int, int]], texts: list[str], batch: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Windows (text, start, end) of like length together, as many as `batch` usual ones have characters, and the ids of their characters."""
    jobs = sorted(jobs, key=lambda j: j[2] - j[1])
    at = 0
    while at < len(jobs):
        part = jobs[at : at + 1]
        while at + len(part) < len(jobs) and (len(part) + 1) * (jobs[at + len(part)][2] - jobs[at + len(part)][1]) <= batch * WINDOW:
            part.append(jobs[at + len(part)])
        pieces = [texts[i][a:b] for i, a, b in part]
        ids = np.zeros((len(part), max(map(len, pieces))), np.int64)
        for n, piece in enumerate(pieces):
            ids[n, : len(piece)] = char_ids(piece)
        yield part, ids
        at += len(part)


def decoded(jobs: list[tuple[int, int, int]], texts: list[str], model: Tagger, batch: int) -> Iterator[tuple[tuple[int, int, int], list[tuple[int, int, str, float]]]]:
    """Windows and their spans."""
    for part, ids in batches_of(jobs, texts, batch):
        yield from zip(part, model.decode(ids))


def suspicions(texts: list[str], coarse: Tagger, least: float, batch: int) -> dict[int, np.ndarray]:
    """For texts that have any, the places in order where the coarse tagger sees a mention with at least this probability. It reads every character."""
    found: dict[int, list[np.ndarray]] = {}
    for part, ids in batches_of([(i, a, b) for i, t in enumerate(texts) for a, b in scan(len(t))], texts, batch):
        for (i, a, _), at in zip(part, coarse.suspected(ids, least)):
            if len(at):
                found.setdefault(i, []).append(a + at)
    return {i: np.unique(np.concatenate(at)) for i, at in found.items()}


def added_spans(texts: list[str], base: list[list[Span]], gate: Gate, model: Tagger, least: float = 0.7, quiet: float = 0.9, suspicion: float = 0.01, batch: int = 3072) -> list[list[Span]]:
    """Spans of the model that overlap no base span, for each text. Its coarse tagger reads every character, the other one the surroundings of all places where that sees a mention
    with the probability `suspicion`; without a coarse one, or for a suspicion of 0, it reads every character itself. Where the gate hits, further windows lie around the hits;
    spans without one must reach `quiet`, others `least`."""
    if suspicion > 0 and (coarse := getattr(model, "coarse", None)):
        reach = len(coarse.p["emb"])
        jobs = [(i, a, b) for i, at in suspicions(texts, coarse, suspicion, batch).items() for a, b in windows(texts[i], at, reach) if a < b]
    else:
        jobs = [(i, a, b) for i, t in enumerate(texts) for a, b in scan(len(t))]
    joined = "\n\n".join(texts)  # one pass of the gate
    hits = gate.hits(joined)
    starts = np.cumsum([0, *(len(t) + 2 for t in texts)])
    owner = np.searchsorted(starts, hits, side="right") - 1
    own = {i: hits[owner == i] - starts[i] for i in np.unique(owner).tolist()}
    jobs = sorted({*jobs, *((i, a, b) for i, at in own.items() for a, b in windows(texts[i], at, gate.span) if a < b)})

    def needed(i: int, a: int, b: int) -> float:
        at = own.get(i, hits[:0])
        return least if np.searchsorted(at, a - gate.span) < np.searchsorted(at, b) else quiet

    found: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    while jobs:
        longer = set()
        for (i, s, e), spans in decoded(jobs, texts, model, batch):
            for a, b, kind, w in spans:
                if (a == 0 and s > 0) or (s + b == e and e < len(texts[i])):  # it may go on
                    longer.add((i, max(0, s + a - (e - s)), min(len(texts[i]), s + b + (e - s))))
                elif w >= needed(i, s + a, s + b):
                    found[i].append((s + a, s + b, kind, w * (b - a)))
        jobs = sorted(longer)
    out = []
    for text, mine, known in zip(texts, found, base):
        taken = np.array(sorted((a, b) for a, b, _ in known), dtype=int).reshape(-1, 2)
        reach = np.maximum.accumulate(taken[:, 1]) if len(taken) else taken[:, 1]

        def clear(a: int, b: int, taken=taken, reach=reach) -> bool:
            n = int(np.searchsorted(taken[:, 0], b))  # base spans that begin before its end
            return n == 0 or reach[n - 1] <= a

        out.append(reconciled([s for s in mine if clear(s[0], s[1]) and valid(text, *s[:3])]))
    return out


def sample_windows(docs: DataFrame, how: Learning, key: str, text: str) -> list[tuple[str, list[Span]]]:
    """Labelled windows of documents chosen by a hash of the id, in the order of a hash of themselves; texts of any length are cut by tasks, so that the driver gets windows only."""
    order = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    holds = F.col(text).rlike("[0-9@]")
    # ids first: tasks would send whole texts for the driver to choose from
    ids = [r["_id"] for cond, n in ((holds, how.docs), (~holds, how.docs // 3)) for r in docs.where(cond).groupBy(F.col(key).cast("long").alias("_id"), order.alias("_o")).agg(F.lit(1)).orderBy("_o").limit(n).collect()]
    chosen = docs.sparkSession.createDataFrame([(i,) for i in ids if i is not None], "_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest(), t, written(s), len(s) > 0) for x in batch.column(0).to_pylist() if x for t, s in labelled_windows(x)}
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))], ["o", "t", "s", "has"])

    cut = docs.join(F.broadcast(chosen), F.col(key).cast("long") == F.col("_id"), "left_semi").select(text).mapInArrow(run, "o string, t string, s string, has boolean").distinct()
    rows = [r for has, n in ((True, how.labelled), (False, how.clean)) for r in cut.where(F.col("has") == has).orderBy("o").limit(n).collect()]
    return [(r["t"], [(int(a), int(b), k) for k, a, b in (x.split(":") for x in r["s"].split(",") if x)]) for r in rows]


def model_for(docs: DataFrame, how: Learning = Learning(), key: str = "doc_id", text: str = "text") -> tuple[Gate, Tagger]:
    """The model of the documents' sample: loaded from the shared folder, or fitted by a task and stored there."""
    spark = docs.sparkSession
    sample = sample_windows(docs, how, key, text)
    name = hashlib.sha256(repr((how, WINDOW, sample)).encode("utf-8", "surrogatepass")).hexdigest()[:32]
    path = f"{model_dir(spark)}/pii-{name}"
    if not _is_stored(spark, path):

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([packed(*fit(sample, how))], pa.binary())], ["model"])

        spark.range(1).coalesce(1).mapInArrow(run, "model binary").write.mode("overwrite").parquet(path)
    return unpacked(bytes(spark.read.schema("model binary").parquet(path).head()[0]))


def _is_stored(spark: SparkSession, path: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def search(docs: DataFrame, how: Learning = Learning(), key: str = "doc_id", text: str = "text", suspicion: float = 0.01) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), a row for each row of docs. suspicion: see `added_spans`."""
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], schema)
    gate, model = model_for(docs, how, key, text)
    names = [f.split()[0] for f in schema.split(", ")]
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [t or "" for t in part.column(1).to_pylist()]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, gate, model, suspicion=suspicion)
                counts = [pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS]
                sums = pa.array([hashlib.sha256(written(b).encode()).hexdigest() if b else empty for b in base], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, sums, pa.array([written([*b, *m]) for b, m in zip(base, more)], pa.string())], names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
