"""Trained operators: gradients, exact inference, held-out accuracy, and rules against plain regular expressions."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skymatch.llm import pii, pii_mentions, pii_model, quality_gam, toxicity
from skymatch.llm.common import Sample, held_out, labelled_rows

EDGES = [(1, None), (2, ""), (3, " \n "), (4, "idiot"), (5, "x" * 30_000), (5, "x" * 30_000), (None, "mail a.b@c.org now"), (6, "words " * 20_000), (7, "퟿é \U0001f600 +1 234 567 8901")]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("score", "spans", "_ws", "_row", "_score", "toxicity", "y")})


# ---- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c in "0123456789"]
        s = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out, key=pii.order)


def test_rules():
    r = random.Random(0)
    pieces = ["a", "B", "9", "1", "255", "256", "0", ".", ".", "@", "@", "-", "_", " ", "  ", "+", "+1", "(", ")", "%", "é", "\n", "1.2.3.4", "a@b.c", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (234) 567-8901", "٣", "@.", "..", "a@b"]
    for _ in range(30_000):
        text = "".join(r.choice(pieces) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == plain(text), text


def test_rules_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "a.b@c." * 50_000, "+1" + " " * 300_000):
        pii.base_spans(text)


def test_tagger_gradients():
    model = pii_model.Tagger.new(e=3, h=4)
    r = np.random.default_rng(0)
    model.p = {k: v.astype(float) + 0.2 * r.standard_normal(v.shape) for k, v in model.p.items()}
    ids = r.integers(1, 98, (3, 7))
    ids[1, 5:] = 0
    tags = r.integers(0, pii_model.TAGS, (3, 7))
    _, g = model.loss(ids, tags)
    for k, v in model.p.items():
        for i in r.integers(0, v.size, 5):
            x = v.flat[i]
            v.flat[i] = x + 1e-5
            up = model.loss(ids, tags)[0]
            v.flat[i] = x - 1e-5
            down = model.loss(ids, tags)[0]
            v.flat[i] = x
            assert abs((up - down) / 2e-5 - g[k].flat[i]) < 1e-6


def test_tagger_inference():
    """Marginals and the best path against all paths of short windows."""
    model = pii_model.Tagger.new(e=3, h=4, seed=1)
    r = np.random.default_rng(1)
    model.p["moves"] = r.standard_normal((pii_model.TAGS, pii_model.TAGS)).astype(np.float32)
    ids = np.array([[5, 6, 7], [8, 9, 0]])
    e = model.emissions(ids).astype(float)
    q = model.marginals(e, np.array([3, 2]))[0]
    for n, t in ((0, 3), (1, 2)):
        score = {}
        for path in itertools.product(range(pii_model.TAGS), repeat=t):
            s = model.p["first"][path[0]] + sum(e[n, i, k] for i, k in enumerate(path)) + sum(model.p["moves"][a, b] for a, b in zip(path, path[1:])) + model.p["last"][path[-1]]
            score[path] = np.exp(s)
        z = sum(score.values())
        for i in range(t):
            for k in range(pii_model.TAGS):
                assert abs(sum(v for p, v in score.items() if p[i] == k) / z - q[n, i, k]) < 1e-4
    assert all(a < b for spans in model.decode(ids) for a, b, _, _ in spans)


def test_reconciled_is_best():
    r = random.Random(4)
    for _ in range(300):
        spans = [(a := r.randint(0, 12), a + r.randint(1, 5), r.choice(pii.KINDS), r.random()) for _ in range(r.randint(0, 8))]
        got = pii.reconciled(spans)
        assert all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        weight = {s[:3]: max(t[3] for t in spans if t[:3] == s[:3]) for s in spans}
        best = max((sum(weight[s] for s in c) for n in range(len(weight) + 1) for c in itertools.combinations(sorted(weight), n) if all(x[1] <= y[0] or y[1] <= x[0] for x, y in itertools.combinations(c, 2))), default=0)
        assert abs(sum(weight[s] for s in got) - best) < 1e-9


class Like:
    """In the gate's and the model's place: what looks like an address or a phone in a window, wherever it ends."""

    span = 8
    email = re.compile(r"[a-z.]+ \[at\] [a-z]+(?: \[dot\] [a-z]+)+")
    phone = re.compile(r"[0-9]{2} \([0-9]{3}\) +[0-9]{3}-[0-9]{4}")

    def hits(self, text):
        return np.array([m.start() for m in re.finditer(r"\[at|\(", text)], int)

    def decode(self, ids):
        texts = ["".join(chr(i + 31) for i in row if i) for row in ids]
        # a model marks mentions that the window cuts, too
        cut = ((re.compile(r"[a-z.]+ \[at\][^0-9]*$"), "email"), (re.compile(r"[0-9]{2} \([0-9]{3}\)[ 0-9-]*$"), "phone"))
        return [[(*m.span(), k, 0.9) for like, k in ((self.email, "email"), (self.phone, "phone"), *cut) for m in like.finditer(t)] for t in texts]


def found(text):
    return {text[a:b] for a, b, _ in pii.added_spans([text], [pii.base_spans(text)], Like(), Like())[0]}


def test_windows_cover_hits_and_overlap():
    r = random.Random(5)
    for _ in range(300):
        text = "x" * r.randint(1, 900)
        hits = np.array(sorted(r.sample(range(len(text)), r.randint(0, min(9, len(text))))), int)
        got = pii.windows(text, hits, 8)
        for h in hits.tolist():
            assert any(a <= max(0, h - pii.AROUND) and min(len(text), h + 20) <= b for a, b in got), (h, got)
        assert all(0 <= a < b <= min(len(text), a + pii.WINDOW) for a, b in got)


def test_mentions_of_any_length():
    for parts in (1, 3, 10, 40):
        name, site = ".".join(["maximilian"] * parts), " [dot] ".join(["example"] * parts)
        assert found(f"Write to: {name} [at] {site} [dot] de 8") == {f"{name} [at] {site} [dot] de"}
    assert found("Call 12 (345)" + " " * 400 + "678-9012 X") == {"12 (345)" + " " * 400 + "678-9012"}


def test_mentions_across_ends_of_windows():
    mail, phone = "m.hohenzollern [at] university [dot] example [dot] de", "12 (345)" + " " * 40 + "678-9012"
    for before in range(0, 130, 3):
        left, right = ("X1 " * 100)[-before or 300 :], " X1" * 40
        assert mail in found(f"{left} {mail}{right}"), before
        assert phone in found(f"{left} {phone}{right}"), before


def test_nothing_hangs_on_the_gate():
    """Whole texts are tagged: mentions are found at any place, though the gate hits nothing."""

    class Blind:
        span = 8

        def hits(self, text):
            return np.zeros(0, int)

    class Sure(Like):
        def decode(self, ids):
            return [[(a, b, k, 0.95) for a, b, k, _ in spans] for spans in super().decode(ids)]

    mail = "m.hohenzollern [at] university [dot] example [dot] de"
    for before in (0, 5, 700, *range(880, 1080, 11), 30_000):
        left = ("X1 " * 10_001)[:before] + " "
        text = f"{left}{mail} X1 {'X1 ' * 400}12 (345) 678-9012"
        got = {text[a:b] for a, b, _ in pii.added_spans([text, "", text], [[], [], []], Blind(), Sure())[2]}
        assert got == {mail, "12 (345) 678-9012"}, before
    for size in (0, 1, 95, 96, 97, 1023, 1024, 1025, 1952, 1953, 50_000):
        got = pii.scan(size)
        assert sorted({c for a, b in got for c in range(a, b)}) == list(range(size)) and sum(b - a for a, b in got) <= 1.2 * size
        assert all(x[1] - y[0] == pii.OVERLAP for x, y in zip(got, got[1:]))


def test_quick_decoding_is_the_same():
    """Emissions in place and the least marginals by single precision against those that training uses, with padding."""
    r = np.random.default_rng(3)
    model = pii_model.Tagger.new(seed=2)
    model.p["moves"] = r.standard_normal((pii_model.TAGS, pii_model.TAGS)).astype(np.float32)
    model.p["bo"][0] = 2
    ids = r.integers(1, pii_model.CHARS, (6, 70))
    ids[1, 1:], ids[2, 40:], ids[3, 69:] = 0, 0, 0
    slow, quick, lengths = model.emissions(ids, {}), model.emissions(ids), (ids > 0).sum(1)
    assert np.abs(slow - quick)[ids > 0].max() < 1e-4
    before, q = quick.copy(), model.marginals(quick.astype(float), lengths)[0]
    got = model.outside(quick, lengths)
    assert (quick == before).all() and np.allclose(got, [x[:n, 0].min() for x, n in zip(q, lengths)], atol=1e-4)


def test_tagger_of_groups():
    """Gradients by finite differences, quick emissions and suspicions against all marginals, with windows that end inside a group."""
    r = np.random.default_rng(4)
    model = pii_model.Tagger.new(e=3, h=4, step=4)
    model.p = {k: v.astype(float) + 0.3 * r.standard_normal(v.shape) for k, v in model.p.items()}
    ids = r.integers(1, 98, (4, 18))
    ids[1, 9:], ids[2, 1:], ids[3, 16:] = 0, 0, 0
    assert model.lengths(ids).tolist() == [5, 3, 1, 4]
    tags = r.integers(0, pii_model.TAGS, (4, 5))
    _, g = model.loss(ids, tags)
    for k, v in model.p.items():
        for i in r.integers(0, v.size, 5):
            x, losses = v.flat[i], []
            for v.flat[i] in (x + 1e-5, x - 1e-5):
                losses.append(model.loss(ids, tags)[0])
            v.flat[i] = x
            assert abs((losses[0] - losses[1]) / 2e-5 - g[k].flat[i]) < 1e-6
    q = model.marginals(model.emissions(ids, {}), model.lengths(ids))[0]
    for least in (0.5, 0.9, 0.97):
        assert [x.tolist() for x in model.suspected(ids, least)] == [[4 * t for t in range(n) if q[w, t, 0] <= 1 - least] for w, n in enumerate(model.lengths(ids))]
    model.p["wo"] *= 1e4  # beyond single precision
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    assert all(0 <= x < 18 for at in model.suspected(ids, 0.5) for x in at.tolist())


def test_windows_without_their_first_characters():
    ids, tags = np.array([[7, 8, 9, 7, 8], [5, 6, 0, 0, 0]]), np.array([[0, 1, 2, 2, 0], [3, 4, 0, 0, 0]])
    got = pii_model.later(ids, tags, 2)
    assert got[0].tolist() == [[9, 7, 8, 0, 0], [5, 6, 0, 0, 0]] and got[1].tolist() == [[1, 2, 0, 0, 0], [3, 4, 0, 0, 0]]
    assert all((a == b).all() for a, b in zip(pii_model.later(ids, tags, 0), (ids, tags)))


def test_coarse_tagger_leaves_little_to_the_fine_one(tagger):
    """The coarse tagger reads every character, and the other one, without the gate, a small part of clean texts; what it finds is what it would find everywhere."""
    _, _, model = tagger
    read = {"fine": 0, "coarse": 0}

    class Blind:
        span = 8

        def hits(self, text):
            return np.zeros(0, int)

    class Counted:
        def __init__(self, model, name):
            self.model, self.name, self.p = model, name, model.p
            self.coarse = model.coarse and Counted(model.coarse, "coarse")

        def decode(self, ids):
            read[self.name] += int((ids > 0).sum())
            return self.model.decode(ids)

        def suspected(self, ids, least):
            read[self.name] += int((ids > 0).sum())
            return self.model.suspected(ids, least)

    r = random.Random(6)
    clean = [prose(r, 900) for _ in range(20)]
    pii.added_spans(clean, [[] for _ in clean], Blind(), Counted(model, "fine"))
    assert sum(map(len, clean)) <= read["coarse"] <= 1.2 * sum(map(len, clean)) and read["fine"] <= 0.1 * read["coarse"]
    texts = [f"{prose(r, r.randint(0, 60))} {pii_mentions.mention(k, r, n)} {prose(r, 40)}" for k, ns in pii_mentions.NOTATIONS.items() for n in ns for _ in range(20)]
    some, all_ = ({(i, *s) for i, x in enumerate(pii.added_spans(texts, [[] for _ in texts], Blind(), model, suspicion=s)) for s in x} for s in (0.01, 0.0))
    assert len(all_) >= 0.8 * len(texts) and len(all_ - some) <= 0.01 * len(all_)


def test_windows_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "(a" * 100_000):
        assert sum(b - a for a, b in pii.windows(text, np.arange(len(text)), 8)) <= 3 * len(text) + pii.WINDOW


def test_gate_takes_long_texts_in_pieces(tagger):
    gate = tagger[1]
    r = random.Random(8)
    text = "".join(r.choice("abc @.12345") for _ in range(5000))
    assert len(gate.hits(text)) and (gate.hits(text, piece=700) == gate.hits(text)).all()
    assert len(gate.hits("")) == 0


def test_mentions_are_of_their_kind():
    r = random.Random(3)
    for kind, notations in pii_mentions.NOTATIONS.items():
        for n in notations:
            for _ in range(300):
                m = pii_mentions.mention(kind, r, n)
                assert pii.valid(m, 0, len(m), kind), (kind, n, m)


def prose(r, n):
    return " ".join("".join(r.choice("aeinorst") + r.choice("hlmdgc") * r.randint(0, 1) for _ in range(r.randint(1, 5))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tagger():
    r = random.Random(9)
    texts = [f"{prose(r, 60)} a{i}@mail.org {prose(r, 30)} +1 (234) 567-89{i % 100:02d} {prose(r, 20)}" for i in range(120)]
    sample = [w for t in texts for w in pii.labelled_windows(t)]
    gate, model = pii_model.unpacked(pii_model.packed(*pii.fit(sample, pii.Learning(generated=6500, epochs=7))))
    return texts, gate, model


def test_model_adds_what_rules_miss(tagger, capsys):
    """The model alone: fresh mentions of each notation, most of which no pattern of the module matches, in fresh prose."""
    texts, gate, model = tagger
    r = random.Random(1)
    found_, all_, wrong = {}, {}, 0
    for kind, notations in pii_mentions.NOTATIONS.items():
        for n in notations:
            rows = []
            for _ in range(50):
                left, m, right = prose(r, r.randint(0, 30)), pii_mentions.mention(kind, r, n), prose(r, 30)
                text = f"{left} {m} {right}"
                if n == "plain" or not pii.base_spans(text):
                    rows.append((text, (len(left) + 1, len(left) + 1 + len(m), kind)))
            got = pii.added_spans([t for t, _ in rows], [[] for _ in rows], gate, model)
            all_[kind, n], found_[kind, n] = len(rows), sum(s in g for (_, s), g in zip(rows, got))
            wrong += sum(len([x for x in g if x != s and not (x[0] < s[1] and s[0] < x[1])]) for (_, s), g in zip(rows, got))
    with capsys.disabled():
        print({f"{k} {n}": f"{found_[k, n]}/{all_[k, n]}" for k, n in all_})
    assert sum(found_.values()) >= 0.9 * sum(all_.values()) and wrong <= 0.01 * sum(all_.values())
    assert all(found_[k] >= 0.7 * all_[k] for k in all_)
    for spelt, kind in (("jane dot doe at mail dot com", "email"), ("jane [at] mail [dot] org", "email"), ("10 [.] 20 [.] 30 [.] 40", "ip"), ("4539  1488  0343  6467", "card"), ("030/123/4567", "phone")):
        left = prose(r, 12)
        text = f"{left} {spelt} {prose(r, 12)}"
        assert not pii.base_spans(text) and (len(left) + 1, len(left) + 1 + len(spelt), kind) in pii.added_spans([text], [[]], gate, model)[0], spelt


def test_clean_texts_stay_clean(tagger):
    texts, gate, model = tagger
    r = random.Random(2)
    clean = ["version 2.0 of 1999, 40% and $12.50 at 10:30:00", "key = \"" + "".join(r.choice("0123456789abcdef") for _ in range(32)) + "\"", "no digits here at all", "", "@", "we met at noon. At that point nothing was said"]
    clean += [f"{prose(r, 20)} {pii_mentions.lookalike(r)} {prose(r, 20)}" for _ in range(300)]
    clean = [t for t in clean if not pii.base_spans(t)]
    assert sum(map(bool, pii.added_spans(clean, [[] for _ in clean], gate, model))) <= 0.02 * len(clean)
    assert not any(pii.added_spans(clean[:6], [[]] * 6, gate, model))
    for t, b in zip(texts, map(pii.base_spans, texts)):
        for x, y, _ in pii.added_spans([t], [b], gate, model)[0]:
            assert all(y <= s[0] or s[1] <= x for s in b)


def test_samples_hold_for_every_layout(spark):
    """Long texts and repeated ids are cut into windows by tasks; the sample doesn't depend on the partitions."""
    rows = [(i % 7, f"{prose(random.Random(i), 40)} a{i}@mail.org " * (400 if i == 3 else 1)) for i in range(30)] + [(1, None), (None, "x@y.zz 12"), (2, "")]
    how = pii.Learning(docs=5, labelled=40, clean=20)
    one, other = (sorted(pii.sample_windows(spark.createDataFrame(rows, "doc_id long, text string").repartition(n, "text"), how, "doc_id", "text")) for n in (1, 7))
    assert one == other and 0 < sum(bool(s) for _, s in one) <= 40 and sum(not s for _, s in one) <= 20


def test_an_empty_table_needs_no_model(spark, monkeypatch):
    monkeypatch.setattr(pii, "model_for", None)
    out = pii.search(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns[:2] == ["doc_id", "n_email"]


def test_model_is_stored(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one a@b.cc two"), (2, "nothing in here to be found by anybody")], "doc_id long, text string")
    how = pii.Learning(generated=40, epochs=1)
    gate, model = pii.model_for(docs, how)
    monkeypatch.setattr(pii, "fit", None)  # what is stored isn't fitted again
    again = pii.model_for(docs, how)
    assert again[0].least == gate.least and all((again[1].p[k] == model.p[k]).all() for k in model.p)


def test_search(spark):
    how = pii.Learning(docs=20, generated=100, epochs=1)
    out = pii.search(frame(spark), how).collect()
    assert len(out) == len(EDGES)
    for key, text in EDGES:
        x = next(r for r in out if r["doc_id"] == key)
        base = plain(text or "")
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in base) for k in pii.KINDS]
        assert x["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(x["spans"].split(",")) | {""}
    assert pii.search(frame(spark).limit(0), how).count() == 0


# ---- toxicity


def test_marginals():
    """Against all paths, for texts of several lengths side by side."""
    r = np.random.default_rng(2)
    moves = r.standard_normal((2, 2))
    lengths = np.array([3, 0, 1, 6, 2])
    e = r.standard_normal(int(lengths.sum()))
    p = toxicity.marginals(e, lengths, moves)[0]
    at = 0
    for n in lengths:
        total, one = 0.0, np.zeros(n)
        for path in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(e[at + i] * y for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            total += w
            one += w * np.array(path, float)
        assert np.allclose(p[at : at + n], one / total)
        at += n


def test_toxicity(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    out = toxicity.scored(docs, labels)
    rows = out.join(labels, "doc_id").withColumn("held", held_out(F.col("doc_id"))).collect()
    held = [x for x in rows if x["held"]]
    hit = [x for x in held if x["toxicity"]["score"] >= 0.5]
    assert sum(x["toxic"] == (x["toxicity"]["score"] >= 0.5) for x in held) >= 0.94 * len(held)
    assert hit and all(x["toxic"] for x in hit)
    for x in hit:
        assert x["toxicity"]["spans"] and all(x["text"][s["start"] : s["end"]].strip() and not re.search(r"\s", x["text"][s["start"] : s["end"]]) for s in x["toxicity"]["spans"])
    again = toxicity.scored(docs.repartition(5), labels).select("doc_id", "toxicity.score")
    assert {x["doc_id"]: round(x["score"], 9) for x in again.collect()} == {x["doc_id"]: round(x["score"], 9) for x in out.select("doc_id", "toxicity.score").collect()}
    edges = toxicity.scored(frame(spark), labels)
    assert edges.count() == len(EDGES) and all(0 <= x["toxicity"]["score"] < 0.5 for x in edges.collect() if x["doc_id"] != 4)
    none = toxicity.scored(frame(spark), labels.limit(0)).collect()
    assert len(none) == len(EDGES) and all(x["toxicity"]["score"] == 0 for x in none)
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_learns_from_other_rows_only(spark):
    """Labels of rows that are held out change nothing."""
    rows = [(i, f"word{i} idiot here" if i % 3 == 0 else f"word{i} there") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int, quality int")
    wrong = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    for score in (lambda y: toxicity.scored(docs, y).select("doc_id", "toxicity.score"), lambda y: quality_gam.scored(docs, y).select("doc_id", "score")):
        assert sorted(map(tuple, score(labels).collect())) == sorted(map(tuple, score(wrong).collect()))


def plain_score(chain, text):
    """The score of a text by its definition: squared marginals over all paths."""
    ws = (text or "").split()
    e = [chain.emission(w) for w in ws]
    total, one = 0.0, [0.0] * len(ws)
    for path in itertools.product((0, 1), repeat=len(ws)):
        v = np.exp(sum(x * y for x, y in zip(e, path)) + sum(chain.moves[a, b] for a, b in zip(path, path[1:])))
        total += v
        one = [o + v * y for o, y in zip(one, path)]
    p = [o / total for o in one]
    return 1 / (1 + np.exp(-(chain.calibration @ [1, np.log1p(sum(x * x for x in p)), max(p, default=0.0)])))


def test_scores_against_all_paths():
    sample = [((f"w{i % 9} v{i % 5} idiot scum x{i % 3}" if i % 4 == 0 else f"w{i % 7} v{i % 6} here and there").split(), int(i % 4 == 0), 1.0) for i in range(200)]
    chain = toxicity.train(sample)
    texts = ["idiot", "w1 v2 here", "", None, "the idiot scum of w3 and so on", "idiot scum idiot scum", "there"]
    got = toxicity.score_texts(texts, chain, toxicity.Emissions(chain))[0]
    assert np.allclose(got, [plain_score(chain, t) for t in texts])
    assert got[0] > 0.5 > got[1]


def test_copies_share_their_weight():
    r = random.Random(0)
    text = [f"w{r.randrange(1000)}" for _ in range(200)]
    near = [*text[:100], "changed", *text[101:]]
    other = [f"w{r.randrange(1000)}" for _ in range(200)]
    passage = [*other[:150], *[f"w{r.randrange(1000)}" for _ in range(150)]]  # half of it is shared, which is no copy
    assert toxicity.copy_weights([text, near, other, text, passage, text], [1, 1, 1, 0, 1, 1]).tolist() == pytest.approx([1 / 3, 1 / 3, 1, 1, 1, 1 / 3])


def test_whole_texts_are_learnt_from(spark):
    """A word that stands at one place only of long texts tells toxic ones, wherever that is."""
    long = lambda i: [f"w{(i * 37 + k) % 400}" for k in range(9000)]
    rows = []
    for i in range(90):
        ws = long(i)
        if i % 3 == 0:
            ws[(i * 811) % 9000] = "vermin"
        rows.append((i, " ".join(ws)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    chain = toxicity.fitted(docs, labels)
    assert chain.emission("vermin") > 0 > chain.emission("w7")


def test_samples_are_weighted_and_hold_for_every_layout(spark):
    """Repeated ids, long texts and more labels than rows: the same sample and scores for each layout, and weights that restore the shares of the classes."""
    rows = [(i, ("idiot scum " if i % 5 == 0 else "some words ") + f"and w{i} " * (3000 if i == 5 else 3)) for i in range(300)] + [(i, f"another text {i % 3} of the id") for i in range(40) for _ in range(2)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0), int(i % 5 != 0)) for i in range(300)], "doc_id long, toxic int, quality int")
    n = {y: labels.where((F.col("toxic") == y) & ~held_out(F.col("doc_id"))).count() for y in (0, 1)}
    how = Sample(rows=60)
    results = []
    for parts in (1, 6):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "text")
        sample = labelled_rows(docs, labels, "toxic", how).select("_id", "_y", "_weight").distinct().collect()
        assert len(sample) == 60 and sum(r["_y"] for r in sample) == 24
        assert {round(sum(r["_weight"] for r in sample if r["_y"] == y), 6) for y in (0, 1)} == set(n.values())
        results.append(sorted((r["doc_id"], r["text"], r["toxicity"]["score"]) for r in toxicity.scored(docs, labels, how).collect()))
        results.append(sorted((r["doc_id"], r["text"], r["score"]) for r in quality_gam.scored(docs, labels, how).collect()))
    assert results[0] == results[2] and results[1] == results[3]


# ---- quality


def plain_best_cuts(g, h, ridge, least):
    """The leaf values of all grids split by a cut on each axis, best gain first."""
    rows, cols = g.shape
    value = lambda a, b: a * a / (b + ridge)
    best = (-1.0, np.zeros_like(g))
    for i, j in itertools.product(range(1, rows), range(1, cols)):
        cells = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, cols)), (slice(i, rows), slice(0, j)), (slice(i, rows), slice(j, cols))]
        gain = sum(value(g[c].sum(), h[c].sum()) for c in cells) - value(g.sum(), h.sum())
        if min(h[c].sum() for c in cells) >= least and gain > best[0] + 1e-12:
            out = np.zeros_like(g)
            for c in cells:
                out[c] = g[c].sum() / (h[c].sum() + ridge)
            best = (gain, out)
    return best


def test_cross_cut_against_all():
    r = np.random.default_rng(5)
    for _ in range(50):
        g, h = r.standard_normal((5, 4)), r.random((5, 4)) + 0.1
        gain, out = quality_gam.cross_cut(g, h, 1.0, 0.3)
        plain_gain, plain_out = plain_best_cuts(g, h, 1.0, 0.3)
        assert np.isclose(gain, plain_gain) and np.allclose(out, plain_out)


def test_training_and_scores_against_plain_version():
    """A few rounds of cyclic boosting, row by row, with weights."""
    r = np.random.default_rng(6)
    x = np.round(r.random((300, 3)), 2)
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.6)).astype(float)
    w = r.choice([1.0, 3.0], 300)
    gam = quality_gam.train(x, y, w, bins=6, coarse=3, rounds=4, pair_rounds=3, pairs=2)
    weight = w / w.mean()
    share = (weight * y).mean()
    score = [float(np.log(share / (1 - share)))] * 300
    bins = [[sum(v >= e for e in edges) for v in x[:, i]] for i, edges in enumerate(gam.edges)]
    tables = [np.zeros(len(e) + 1) for e in gam.edges]

    def sums(cells, shape):
        g, h = np.zeros(shape), np.zeros(shape)
        for c, s, target, k in zip(cells, score, y, weight):
            p = 1 / (1 + np.exp(-s))
            g[c] += k * (target - p)
            h[c] += k * p * (1 - p)
        return g, h

    for _ in range(4):
        for i, t in enumerate(tables):
            step = 0.1 * quality_gam.two_cuts(*sums(bins[i], len(t)), 2.0, 1.0)
            tables[i] = t + step
            score = [s + step[b] for s, b in zip(score, bins[i])]
    coarse = [[b * 3 // len(t) for b in bins[i]] for i, t in enumerate(tables)]
    cells = {(i, j): list(zip(coarse[i], coarse[j])) for i in range(3) for j in range(i)}
    gains = sorted(((plain_best_cuts(*sums(c, (3, 3)), 2.0, 1.0)[0], k) for k, c in cells.items()), reverse=True)[:2]
    pairs = {k: np.zeros((3, 3)) for _, k in gains}
    for _ in range(3):
        for k in pairs:
            step = 0.1 * plain_best_cuts(*sums(cells[k], (3, 3)), 2.0, 1.0)[1]
            pairs[k] = pairs[k] + step
            score = [s + step[c] for s, c in zip(score, cells[k])]
    assert [(i, j) for i, j, _ in gam.pairs] == list(pairs)
    assert all(np.allclose(a, b) for a, b in zip(gam.single, tables)) and all(np.allclose(t, pairs[i, j]) for i, j, t in gam.pairs)
    assert np.allclose(gam.score(x), 1 / (1 + np.exp(-np.array(score))))


def test_quality(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = quality_gam.scored(docs, labels).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(x["quality"] == (x["score"] >= 0.3) for x in rows) >= 0.95 * len(rows)
    edges = quality_gam.scored(frame(spark), labels)
    assert edges.count() == len(EDGES) and all(0 <= x["score"] <= 1 for x in edges.collect())
    assert quality_gam.scored(docs.limit(0), labels).count() == 0
    assert {x["score"] for x in quality_gam.scored(docs, labels.limit(0)).collect()} == {0.5}


def test_interactions_are_learnt():
    """An exclusive or of two features has no main effect."""
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality_gam.train(x[:3000], y[:3000])
    assert ((gam.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert gam.pairs[0][:2] == (1, 0)


def test_two_cuts_against_all():
    r = np.random.default_rng(1)
    for _ in range(50):
        g, h = r.standard_normal(9), r.random(9) + 0.5
        out = quality_gam.two_cuts(g, h, 1.0, 0.1)
        gain = lambda parts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0) for a, b in parts)
        first = max(range(1, 9), key=lambda i: gain([(0, i), (i, 9)]))
        leaves = len(np.unique(out.round(12)))
        assert leaves <= 3 and (leaves == 1 or out[first - 1] != out[first])
