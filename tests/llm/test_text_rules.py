"""Quality rules, line dedup, URL filters and mixing against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skymatch.llm import line_dedup, mixing, quality_rules, queries, url_filter

from .helpers import WORD

EDGES = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "a b c d e f g h " * 5, "b"), (5, "x" * 50_000, None), (6, "the # of % and\nthe # of % and\n\n", "a"), (6, "the # of % and\nthe # of % and\n\n", "a"),
    (7, " ".join(f"w{i}" for i in range(30)), "c"), (None, "one two", "c"), (8, "a\u00a0b \x1f c", None), (9, "Ä Ö ü ß\r\nÄ Ö ü ß\r\n", "d"),
]


def frame(spark, rows=EDGES):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("clash") for c in ("_n", "kept", "_version", "_key", "_id", "_rank", "_row", "size", "key", "pos", "n_lines", "_copies")})


def brute_measures(text):
    text = text or ""
    ws = WORD.findall(text)
    windows = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + j for i in range(len(ws) - 7) if windows[tuple(ws[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    r = random.Random(1)
    odd = [(10_000 + i, "".join(r.choice(["a ", "b ", "c\n", "d  ", "\x0b"]) for _ in range(r.randint(0, 200))), "s") for i in range(60)]
    rows = EDGES + docs + odd
    out = quality_rules.judge(frame(spark, rows)).collect()
    got = Counter((x["doc_id"], x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"], x["base_failed"]) for x in out)
    want = Counter()
    for i, t, _ in rows:
        m = brute_measures(t)
        want[(i, *m, m[0] < 20 or 100 * m[4] > 30 * m[0])] += 1
    assert got == want
    assert all(not x["kept"] for x in out if x["base_failed"])
    assert quality_rules.judge(frame(spark).limit(0)).count() == 0


def test_rules_tell_junk(spark, sf):
    """Most of label 0 goes, and label 1 stays but for what the base rule rejects."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_rules.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(labels, "doc_id").collect()
    bad = [x for x in out if x["quality"] == 0]
    assert sum(x["kept"] for x in bad) <= 0.1 * len(bad)
    assert all(x["kept"] for x in out if x["quality"] == 1 and not x["base_failed"])


def test_native_plans(spark, sf):
    for name in ("op1_quality_rules", "op9_line_dedup", "op10_url_filter"):
        plan = queries.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan), name


def brute_lines(rows, least):
    sites, first = defaultdict(set), {}
    for key, text, site in rows:
        for i, line in enumerate((text or "").split("\n")):
            if WORD.search(line):
                sites[line].add(site)
                first[line] = min(first.get(line, (key, i)), (key, i))
    out = {}
    for key, text, _ in rows:
        if text is None:
            out[key] = (None, 0, 0)
            continue
        lines = text.split("\n")
        gone = {i for i, x in enumerate(lines) if WORD.search(x) and len(sites[x]) >= least and first[x] != (key, i)}
        out[key] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), sum(bool(WORD.search(x)) for x in lines), len(gone))
    return out


@pytest.mark.parametrize("least", [2, 3, 30])
def test_lines(spark, least):
    r = random.Random(least)
    pool = [f"line {i}" for i in range(25)] + ["", " ", "unique"]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(0, 12))), r.choice(["a", "b", None, *(f"s{k}" for k in range(60))])) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "line 1\n" * 3000, "c")]
    out = {x["doc_id"]: (x["text"], x["n_lines"], x["n_removed"]) for x in line_dedup.dedup_lines(frame(spark, rows), least).collect()}
    assert out == brute_lines(rows, least)


def test_lines_of_edges(spark):
    out = line_dedup.dedup_lines(frame(spark))
    assert out.count() == len(EDGES) and out.columns[:5] == ["doc_id", "text", "source", "_n", "kept"] and out.columns[-2:] == ["n_lines", "n_removed"]
    assert {r["_version"] for r in out.collect()} == {"clash"}
    assert line_dedup.dedup_lines(frame(spark).limit(0)).count() == 0


RULES = queries.URL_RULES


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :], re.S)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for r in RULES:
        name, rest_ = r.rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest_) and (best is None or len(r.rule) > len(best.rule)):
            best = r
    return host, path, best and best.rule, best and best.verdict


URLS = [
    None, "", "no scheme/here", "http://", "http://A.Example.NET/en/1", "https://example.net/en", "https://example.net/en/x?y#z", "x://net/", "x://net", "x://mynet/", "http://b.example.com/de/5", "http://example.org/fr/",
    "http://org/fr/9://net/", "http://h/?a", "http://h#b", "http://ÄB.net/é", "http://example.net?x", "http://h/" + "a/" * 500,
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string").withColumn("host", F.lit("clash"))
    out = url_filter.judge(pages, RULES).collect()
    assert len(out) == 2 * len(URLS)
    for x in out:
        host, path, rule, verdict = brute_rule((URLS + URLS)[x["page_id"]])
        assert (x["host"], x["path"], x["rule"]) == (host, path, rule)
        assert x["verdict"] == (verdict or "allow")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0


def test_templates_reject_by_labels(spark):
    """A branch with bad labels goes, its sibling stays, also for pages without labels."""
    rows = [(i, f"http://site/bad/{i}.html") for i in range(200)] + [(200 + i, f"http://site/good/{200 + i}") for i in range(200)] + [(400 + i, f"http://site/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100]}/1") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 200)) for i in range(0, 400, 2)], "label_id long, bad int")
    out = url_filter.judge(pages, [], labels).collect()
    verdicts = {x["page_id"]: x["verdict"] for x in out}
    assert all(verdicts[i] == "block" for i in range(200)) and all(verdicts[i] == "allow" for i in range(200, 400))
    assert {x["template"] for x in out if x["page_id"] >= 400} == {"/*/#"}


def test_small_branches_keep_their_own_labels(spark):
    """Rare directories and deep ones whose labels differ aren't pooled with clean ones."""
    rows = [(i, f"http://hot/{'bad' if i < 38 else f'dir{chr(97 + i % 13)}{chr(97 + i // 13 % 8)}'}/{i}") for i in range(2000)]
    rows += [(2000 + i, f"http://even/s{chr(97 + i % 10)}{chr(97 + i // 10 % 6)}/{2000 + i}") for i in range(3600)]
    rows += [(6000 + i, f"http://deep/a/b/c/x{chr(97 + i % 20)}/{'bad' if i % 2 else 'good'}/p/{6000 + i}") for i in range(800)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    bad = {i for i, u in rows if "/bad/" in u or "/sa" in u}
    labels = spark.createDataFrame([(i, int(i in bad)) for i, _ in rows], "label_id long, bad int")
    out = {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, [], labels).collect()}
    assert {i for i, v in out.items() if v == "block"} == bad


def apart(n, k, n2, k2, z=1.96):
    if not n or not n2:
        return False
    p = (k + k2) / (n + n2)
    return abs(k / n - k2 / n2) > z * math.sqrt(p * (1 - p) * (1 / n + 1 / n2))


def brute_groups_of(branches):
    """{step: (labelled, bad)} of one parent: {step: name of its group}, where there are two or more in it."""
    add = lambda xs: tuple(map(sum, zip(*xs))) if xs else (0, 0)
    less = lambda a, b: (a[0] - b[0], a[1] - b[1])
    known = {s: x for s, x in branches.items() if x[0]}
    everything = add(list(known.values()))
    near = {s for s, x in known.items() if not apart(*x, *less(everything, x))}
    pool = add([known[s] for s in near])
    core = {s for s, x in known.items() if pool[0] and not apart(*x, *(less(pool, x) if s in near else pool))}
    n, k = pool if pool[0] else everything
    sides = {s: "?m" if s in core else "?h" if x[1] * n > x[0] * k else "?l" for s, x in known.items()}
    out = {}
    for s, x in known.items():
        side = add([known[o] for o in known if sides[o] == sides[s]])
        if s in core or not apart(*x, *less(side, x)):
            out[s] = sides[s]
    return {s: g for s, g in out.items() if list(out.values()).count(g) > 1}


def brute_templates(shapes, how=url_filter.Templates()):
    """{(host, path shape): (pages, labelled, bad)}: their templates, parent by parent."""
    out = {}

    def walk(rows, prefix, level):
        """rows: {(host, shape): parts} below one parent."""
        if len(rows) == 1:
            (key, parts), = rows.items()
            if len(parts) > level:
                out[key] = prefix + "/" + "/".join(p if shapes[key][0] >= how.literal_pages else "*" for p in parts[level:])
                return
        if all(len(p) <= level for p in rows.values()):
            out.update({key: prefix for key in rows})
            return
        seg = {key: parts[level] if len(parts) > level else "" for key, parts in rows.items()}
        sums = lambda keys: tuple(sum(shapes[x][i] for x in keys) for i in range(3))
        total, steps = sums(rows), {}
        for s in set(seg.values()):
            n, labelled, bad = sums([x for x in rows if seg[x] == s])
            frequent = n >= how.literal_pages and n >= how.literal_share * total[0]
            own = labelled >= how.own_labelled and apart(labelled, bad, total[1] - labelled, total[2] - bad)
            steps[s] = s if frequent or own else "*"
        branches = {}
        for x in rows:
            old = branches.get(steps[seg[x]], (0, 0))
            branches[steps[seg[x]]] = (old[0] + shapes[x][1], old[1] + shapes[x][2])
        group = brute_groups_of(branches)
        below = {}
        for x, parts in rows.items():
            if len(parts) <= level:
                out[x] = prefix
            else:
                step = steps[seg[x]]
                below.setdefault(group.get(step, step), {})[x] = parts
        for step, part in below.items():
            walk(part, f"{prefix}/{step}", level + 1)

    for host in {h for h, _ in shapes}:
        walk({x: (x[1][1:] if x[1].startswith("/") else x[1]).split("/") for x in shapes if x[0] == host}, "", 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_tree_against_brute_force(spark, seed):
    """Templates, shares and verdicts, with branches that a merge of all siblings would have blocked or saved."""
    r = random.Random(seed)
    rows, bad = [], {}
    rate = {}
    for i in range(4000):
        host = r.choice(["hot", "hot", "b.net", "c"])
        parts = [r.choice(["en", "de", "fr", "es", "spam", "junk", f"v{chr(97 + r.randrange(26))}{chr(97 + r.randrange(26))}"]), *(r.choice(["x", "y", "z", "bad"]) for _ in range(r.randint(0, 3)))]
        stem = (host, parts[0], "bad" in parts)
        rate.setdefault(stem, r.choice([0.02, 0.05, 0.5, 0.95] if parts[0] not in ("spam", "junk") else [0.9, 1.0]))
        rows.append((i, f"http://{host}/{'/'.join(parts)}/{i}"))
        if r.random() < 0.3:
            bad[i] = int(r.random() < rate[stem])
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame(list(bad.items()), "label_id long, bad int")
    out = {x["page_id"]: x for x in url_filter.judge(pages, [], labels).collect()}
    shapes = {}
    where = {}
    for i, u in rows:
        host, path = u[7:].split("/", 1)
        where[i] = key = (host, re.sub("[0-9]+", "#", "/" + path))
        n, labelled, k = shapes.get(key, (0, 0, 0))
        shapes[key] = (n + 1, labelled + (i in bad), k + bad.get(i, 0))
    templates = brute_templates(shapes)
    prior = sum(bad.values()) / len(bad)
    sums = {}
    for key, t in templates.items():
        n, k = sums.get((key[0], t), (0, 0))
        sums[key[0], t] = (n + shapes[key][1], k + shapes[key][2])
    for i, key in where.items():
        n, k = sums[key[0], templates[key]]
        share = (k + 20 * prior) / (n + 20)
        assert out[i]["template"] == templates[key] and abs(out[i]["bad_share"] - share) < 1e-9 and out[i]["verdict"] == ("block" if share >= 0.5 else "allow"), (i, key)
    assert {x["verdict"] for x in out.values()} == {"allow", "block"} and any("?" in x["template"] for x in out.values())


def test_long_chains_are_one_step(spark):
    """Paths of 1,000 segments that fork late, as a brute-force tree has them, in a few rounds."""
    import time

    trap = "/".join(f"s{chr(97 + i % 26)}" for i in range(990))
    rows = [(i, f"http://trap/{trap}/{'abcd'[i % 4]}/{'xy'[i // 4 % 2]}/{i}") for i in range(40)] + [(100 + i, f"http://trap/other/{trap}/{100 + i}/deep") for i in range(2)] + [(200, f"http://trap/{trap}")]
    pages, labels = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(40)], "label_id long, bad int")
    began = time.time()
    out = {x["page_id"]: x["template"] for x in url_filter.judge(pages, [], labels).collect()}
    took = time.time() - began
    shapes, where = {}, {}
    for i, u in rows:
        key = ("trap", re.sub("[0-9]+", "#", u[11:]))
        where[i], n = key, shapes.get(key, (0, 0, 0))
        shapes[key] = (n[0] + 1, n[1] + (i < 40), n[2] + (i < 40 and i % 4 == 1))
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(10_000)
    try:
        want = brute_templates(shapes)
    finally:
        sys.setrecursionlimit(limit)
    assert {i: out[i] for i in where} == {i: want[k] for i, k in where.items()}
    assert took < 120  # a round a level would be some 1,000 rounds of seconds


def test_the_query_blocks_what_labels_teach(spark, tmp_path):
    """Tables whose labels are bad below one template: the registered query blocks it, unlabelled pages too, as its SQL does."""
    import duckdb

    from skymatch.llm.queries import ORACLE_SQL, op10_url_filter

    rows = [(i, f"https://Shop.example/{'cheap' if i % 3 == 0 else 'news'}/{'ab'[i // 2 % 2]}/{i}") for i in range(600)] + [(i, f"https://x.example.net/en/cheap/{i}") for i in range(600, 620)] + [(999, None)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/l")
    for name, short in (("pages", "p"), ("labels", "l")):
        next((tmp_path / short).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = {r["page_id"]: tuple(r) for r in op10_url_filter(spark, str(tmp_path)).collect()}
    assert all(got[i][4] == ("block" if i % 3 == 0 and i < 600 else "allow") for i in got)
    db = duckdb.connect()
    for name in ("pages", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    sql = db.execute(ORACLE_SQL["op10_url_filter"])
    at = [[d[0] for d in sql.description].index(c) for c in ("page_id", "host", "path", "rule", "verdict")]
    assert {r[at[0]]: tuple(r[i] for i in at) for r in sql.fetchall()} == got


def test_siblings_that_differ_lend_no_labels(spark):
    """A branch of bad labels alone says nothing about one without labels; a learned block reaches unlabelled pages of its own template."""
    rows = [(i, f"http://s/bad/{i}") for i in range(100)] + [(100 + i, f"http://s/new/{100 + i}") for i in range(100)] + [(200 + i, f"http://s/ok/{200 + i}") for i in range(100)] + [(300 + i, f"http://s/bad/{300 + i}") for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(100)] + [(i, 0) for i in range(200, 300)], "label_id long, bad int")
    out = {x["page_id"]: x["verdict"] for x in url_filter.judge(pages, [], labels, url_filter.Templates(reject=0.6)).collect()}
    assert all(out[i] == ("block" if i < 100 or i >= 300 else "allow") for i in out)


def brute_targets(sizes, weights=(5, 2, 1)):
    """Shares, the excess above twice a source's size dealt anew until there is none."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(w[s] for s in open_)
        give = {s: left * w[s] / total for s in open_}
        left = 0.0
        for s, g in give.items():
            target[s] += g
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2 * sizes[s]
                open_.discard(s)
    return target


def check_mix(out, rows):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for x in out:
        taken[x["source"]] += x["taken"]
        assert x["taken"] in (0, x["size"], 2 * x["size"])
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6 * max(1, want[x["source"]])
    for s, n in taken.items():
        longest = max(len(WORD.findall(t or "")) for _, t, o in rows if o == s)
        assert abs(n - want[s]) <= longest / 2 + 1e-6


def test_mix(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    r = random.Random(2)
    made = [(i, "w " * r.randint(0, 9), r.choice("AAAAABBC")) for i in range(900)]
    for rows in (docs, EDGES, made, EDGES + docs):
        plan = mixing.mix(frame(spark, rows), mixing.line_weight(F.col("text")))
        out = plan.collect()
        assert len(out) == len(rows)
        check_mix(out, rows)
        assert Counter(map(str, out)) == Counter(map(str, mixing.mix(frame(spark, rows).repartition(3), mixing.line_weight(F.col("text"))).collect()))
        mixed = mixing.mixed(frame(spark, rows), mixing.line_weight(F.col("text")))
        assert mixed.count() == sum(x["copies"] for x in out) and mixed.columns == frame(spark).columns
    assert mixing.mix(frame(spark).limit(0), F.lit(1.0)).count() == 0


def test_weights_matter(spark):
    """Documents of greater weight are taken more often."""
    rows = [(i, "w w w w", "A" if i % 10 else "B") for i in range(4000)]
    df = frame(spark, rows)
    out = mixing.mix(df, F.when(F.col("doc_id") % 2 == 0, 5.0).otherwise(1.0), weights=(1, 100)).where("source = 'A'").collect()
    share = [sum(x["taken"] for x in out if x["doc_id"] % 2 == k) for k in (0, 1)]
    assert share[0] > 1.1 * share[1]


def test_mixed_keeps_rows_that_differ_in_other_columns(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "fr"), (1, "a b c", "s", "fr"), (2, "d e f", "s", None), (None, "g h", None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out = Counter(tuple(r) for r in mixing.mixed(df, F.lit(1.0), weights=(1,), share=2.0, most=2.0).collect())
    assert out == Counter({r: 2 * n for r, n in Counter(rows).items()})
    maps = df.withColumn("m", F.create_map(F.lit("k"), "lang"))
    assert Counter((r[0], r[3], r["m"]["k"]) for r in mixing.mixed(maps, F.lit(1.0), weights=(1,), share=2.0).collect()) == Counter((r[0], r[3], r[3]) for r in out.elements())


def test_lines_of_a_very_long_text(spark):
    """200,000 lines, all but a few removed or kept in stretches, in linear time."""
    import time

    long = "\n".join(f"line {i % 100_000} here" for i in range(200_000))
    docs = spark.createDataFrame([(i, long, s) for i, s in enumerate("abc")] + [(9, "line 5 here\nown", "d")], "doc_id long, text string, source string")
    began = time.time()
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert time.time() - began < 60
    assert out[0]["n_removed"] == 100_000 and out[0]["text"].split("\n") == long.split("\n")[:100_000]
    assert out[1]["text"] == out[2]["text"] == "" and out[1]["n_removed"] == 200_000 and out[9]["text"] == "own"
    assert line_dedup.dedup_lines(docs, counts=False).columns == docs.columns
