"""Every operator against a brute-force version, and on documents that stress it."""
from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from signalyard.llm import common, mixing, packing, pii, quality, queries, simhash, sketch, suffix_dedup, token_store, toxicity, url_rules
from signalyard.llm.tokens import Encoder

from . import fixtures

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def table(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# 1: mixing
def test_targets_stop_at_three_times_the_source():
    t = mixing.target_words([("a", 100), ("b", 10), (None, 10)])
    assert t["b"] == 30 and t[None] == 30 and t["a"] == pytest.approx(60)
    assert mixing.target_words([("a", 0)]) == {"a": 0.0} and mixing.target_words([]) == {}


def test_mix_takes_what_its_sources_are_due(spark):
    docs = fixtures.frame(spark)
    plan = common.written(mixing.mix_sources(mixing.sized(docs), buckets=4), "t")
    rows = mixing.taken_words(plan).collect()
    sizes = {i: len(SPACE.findall(t or "")) for i, t, *_ in fixtures.rows()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    by = collections.defaultdict(int)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]] += r["taken"]
    for r in rows:
        assert abs(by[r["source"]] - r["target"]) <= mixing.PACKET_WORDS
    assert sum(by.values()) == sum(sizes.values())
    again = common.written(mixing.mix_sources(mixing.sized(docs.repartition(7)), buckets=4), "t")
    assert sorted(map(tuple, mixing.taken_words(again).collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_is_served_by_finish_time_and_cut_at_the_budget(spark):
    plan = common.written(mixing.mix_sources(mixing.sized(fixtures.frame(spark)), buckets=4), "t")
    seq = sorted(mixing.mixed_sequence(plan, slots=8).collect(), key=lambda r: r["position"])
    assert [r["finish"] for r in seq] == sorted(r["finish"] for r in seq)
    at = 0
    for r in seq:
        assert r["position"] == at
        at += r["take"]
    assert at == sum(len(SPACE.findall(t or "")) for _, t, *_ in fixtures.rows())


def test_mix_is_that_of_a_queue_served_one_by_one(spark):
    plan = common.written(mixing.mix_sources(mixing.sized(fixtures.frame(spark)), buckets=4), "t")
    docs = plan.collect()
    queue = []
    for r in docs:
        for turn in range(3 if r["size"] else 0):
            at, end = turn * r["source_size"] + r["before"], turn * r["source_size"] + r["before"] + r["size"]
            if end <= r["target"]:
                queue.append((end / r["target"], r["_k"], r["doc_id"], at, r["size"]))
            else:
                cuts = list(range(at, end, mixing.PACKET_WORDS)) + [end]
                queue += [(b / r["target"], r["_k"], r["doc_id"], a, b - a) for a, b in zip(cuts, cuts[1:])]
    left, want = docs[0]["budget"], collections.Counter()
    assert sum(n for *_, n in queue) > left  # the budget cuts the queue
    for _, _, i, _, n in sorted(queue, key=lambda q: (q[0], q[1], q[2] is not None, q[2] or 0, q[3])):
        want[i] += min(n, left)
        left -= min(n, left)
    got = {r["doc_id"]: r["taken"] for r in mixing.taken_words(plan).collect()}
    assert left == 0 and got == {r["doc_id"]: want[r["doc_id"]] for r in docs}


def test_mix_serves_a_very_long_document_in_part(spark):
    odd = [(i, f"word {i} of a short text", "en", "a", 1, "x", "y", "z") for i in range(200)] + [(999, "long " * 5000, "en", "b", 1, "x", "y", "z")]
    docs = spark.createDataFrame(odd, fixtures.empty(spark).schema)
    rows = mixing.taken_words(common.written(mixing.mix_sources(mixing.sized(docs)), "t")).collect()
    by = collections.Counter()
    for r in rows:
        by[r["source"]] += r["taken"]
    assert all(abs(by[r["source"]] - r["target"]) <= mixing.PACKET_WORDS for r in rows)


def test_mix_does_not_multiply_rows_that_share_an_id(spark):
    odd = [(None, f"text {i} without an id", "en", "s1", 1, "x", "y", "z") for i in range(30)]
    odd += [(5, "one id with two texts, the first", "en", "s1", 1, "x", "y", "z"), (5, "one id with two texts, the second", "en", "s1", 1, "x", "y", "z")]
    odd += [(6, "the same row three times over", "en", "s1", 1, "x", "y", "z")] * 3
    docs = spark.createDataFrame(odd, fixtures.empty(spark).schema)
    assert collections.Counter(map(tuple, mixing.mix_documents(docs).collect())) == collections.Counter(odd)


def test_mix_on_repeated_null_and_empty(spark):
    docs = fixtures.repeated_and_null(spark)
    assert mixing.taken_words(common.written(mixing.mix_sources(mixing.sized(docs)), "t")).select(F.sum("size")).first()[0] > 0
    assert mixing.mix_documents(docs).columns == docs.columns
    assert mixing.taken_words(common.written(mixing.mix_sources(mixing.sized(fixtures.empty(spark))), "t")).count() == 0


def test_mix_gives_every_repeated_row_without_words(spark):
    odd = [(7, "", "en", "s1", 0, "x", "y", "z")] * 3 + [(None, None, "en", "s1", None, "x", "y", "z")] * 2 + [(8, "three words here", "en", "s1", 16, "x", "y", "z")] * 2
    docs = fixtures.frame(spark, odd)
    rows = mixing.taken_words(common.written(mixing.mix_sources(mixing.sized(docs)), "t")).collect()
    want = collections.Counter(r["doc_id"] for r in docs.collect())
    assert collections.Counter(r["doc_id"] for r in rows) == want and want[7] == 3


def test_columns_of_any_name_pass_through(spark):
    rows = [(i, f"words number {i} of the text that is here for all to read now {i * 7}", "en", "s", 1, i, "c", "d") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __id int, __copies string, __hash string")
    for out in (mixing.mix_documents(docs), simhash.one_of_each(docs)):
        assert out.columns == docs.columns and out.count() > 0 and out.filter("__id <> doc_id or __copies <> 'c' or __hash <> 'd'").count() == 0


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://there:7077"

        def getConf(self):
            return {}

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        common.shared_folder(Session())


# 2: URL rules
def reference_rule(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else (None, None)


URLS = ["http://A.Example.org/es/1", "https://example.org/en/17", "https://x.org", "ftp://a.com/de/", "http://b.com/fr/2?x=/de/", "http://b.com/x/fr/", "none", None, "", "http://example.org.net/es/", "http://É.com/de/1#f", "a://b://c.com/de/", "http://c.com?/de/", "HTTP://NET/de/5"]


def test_listed_rules(spark):
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(None, URLS[0]), (0, URLS[0])], "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = url_rules.judge(rows).collect()
    assert len(got) == len(URLS) + 2
    by = {r["page_id"]: r for r in got}
    for i, u in enumerate(URLS):
        host, path, (rule, verdict) = reference_rule(u)
        assert (by[i]["host"], by[i]["path"], by[i]["rule"]) == (host, path, rule)
        assert by[i]["verdict"] == (verdict or by[i]["verdict"]) and by[i]["verdict"] in ("allow", "block")
    assert url_rules.judge(rows.limit(0)).count() == 0


def test_mined_rules_have_their_support_and_confidence(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b"], "allow")] * 1 + [(["d"], "block")] * 2
    kept, items = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), support=0.1, confidence=0.8)
    found = kept.collect()
    for r in found:
        have = [v for t, v in rows if set(r["items"]) <= set(t)]
        assert have.count(r["verdict"]) / len(have) == pytest.approx(r["confidence"]) and r["confidence"] >= 0.8
        assert have.count(r["verdict"]) / len(rows) == pytest.approx(r["support"])
    assert {(tuple(r["items"]), r["verdict"]) for r in found} == {(("c",), "allow"), (("b",), "block"), (("a", "b"), "block"), (("d",), "block")}
    sets = spark.createDataFrame([(["a", "b"],), (["c", "z"],), (["z"],)], "tokens array<string>")
    for most in (10, 0):  # by broadcast and by shuffle
        assert {tuple(r["tokens"]): r["verdict"] for r in url_rules.match(sets, kept, items, most).collect()} == {("a", "b"): "block", ("c", "z"): "allow"}


def mined_by_hand(rows, support, confidence):
    """All rules of all item sets, without those of which a part is as confident."""
    n, found = len(rows), {}
    tokens = sorted({t for r, _ in rows for t in r})
    for size in range(1, 5):
        for body in itertools.combinations(tokens, size):
            have = [v for r, v in rows if set(body) <= set(r)]
            for v in set(have):
                if have.count(v) / n >= support - 1e-12 and have.count(v) / len(have) >= confidence:
                    found[body, v] = have.count(v) / len(have), have.count(v) / n
    return {(b, v): c for (b, v), c in found.items() if not any((p, v) in found and found[p, v][0] >= c[0] for p in itertools.combinations(b, len(b) - 1) if p)}


def test_verdicts_of_unlisted_urls_end_to_end(spark):
    """Rules mined and applied by hand, through the registered judge."""
    rng = random.Random(4)
    urls = [f"http://{rng.choice(['a', 'b', 'c'])}.{rng.choice(['com', 'org', 'net', 'io'])}/{rng.choice(['fr', 'de', 'es', 'en'])}/{rng.choice(['x', 'y', 'shop'])}?{rng.choice(['q', 'id'])}=1" for _ in range(160)]
    got = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), support=0.05, confidence=0.6).collect()

    def held(u):
        host, path = re.match(r".*?://([^/]*)([^?]*)", u).groups()
        return sorted({*(f"host:{x}" for x in host.split(".")), *(f"path:{x}" for x in path.split("/") if x), f"key:{u.split('?')[1][:-2]}"})

    labelled = [(held(u), reference_rule(u)[2][1]) for u in urls if reference_rule(u)[2][1]]
    rules = mined_by_hand(labelled, 0.05, 0.6)
    seen = 0
    for r in got:
        if r["rule"] is None:
            fits = [(c, s, -len(b), v, " ".join(b)) for (b, v), (c, s) in rules.items() if set(b) <= set(held(urls[r["page_id"]]))]
            assert r["verdict"] == (max(fits)[3] if fits else "allow"), urls[r["page_id"]]
            seen += bool(fits)
    assert seen > 20


def test_a_long_shared_path_is_one_item(spark):
    deep = "/".join(f"part{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'abcdefghij'[k // 26]}" for k in range(40))
    urls = [f"http://x{'abcdefgh'[i % 8]}.com/de/{deep}/{i}" for i in range(200)] + [f"http://y.org/{i}" for i in range(100)]
    urls += [f"http://z.net/{deep}/1", "http://z.net/q/partba/1"]
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert got[300] == "block" and got[301] == "block" and got[299] == "allow"


# 3: repeats
def covered(texts, depth):
    seen = collections.Counter(x[i : i + depth] for x in texts for i in range(len(x) - depth + 1))
    out = []
    for x in texts:
        m = bytearray(len(x))
        for i in range(len(x) - depth + 1):
            if seen[x[i : i + depth]] > 1:
                m[i : i + depth] = b"\1" * depth
        out.append(bytes(m))
    return out


@pytest.mark.parametrize("depth", [200, 64])
def test_repeats_are_removed_exactly(spark, depth):
    docs = fixtures.frame(spark)
    got = table(suffix_dedup.remove_repeats(docs, depth=depth))
    texts = [(t or "").encode() for _, t, *_ in fixtures.rows()]
    for (i, *_), x, m in zip(fixtures.rows(), texts, covered(texts, depth), strict=True):
        kept = bytes(c for c, gone in zip(x, m, strict=True) if not gone)
        runs = m.count(b"\0\1") + m.startswith(b"\1")
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept"]) == (len(x), sum(m), runs, kept), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def test_repeats_on_odd_rows(spark):
    docs = fixtures.repeated_and_null(spark)
    out = suffix_dedup.remove_repeats(docs, with_text=False)
    long_ = len(fixtures.rows()[3][1].encode()) >= 200
    assert out.count() == docs.count() and out.filter("doc_id = 30").count() == 3
    assert out.filter("doc_id = 30 and n_removed = n_bytes").count() == 3 * long_
    assert suffix_dedup.remove_repeats(fixtures.empty(spark)).count() == 0


@pytest.mark.parametrize("limit", [1, 2, 7])
def test_large_groups_are_quartered_without_loss(spark, limit):
    """Documents that share a line, or a passage, amid different words."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(17), prose(40)
    texts = [f"{prose(30)} {(line, passage, passage[:150])[k % 3]} {prose(30)}" for k in range(36)]
    texts += [texts[0], texts[1], texts[1][50:]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    plain = [t.encode() for t in texts]
    for depth in (200, 64):
        wanted = covered(plain, depth)
        got = {i: covered_by([tuple(r)[2:] for r in rows]) for i, rows in grouped(suffix_dedup.spans(docs, depth=depth, limit=limit).collect()).items()}
        assert all(got.get(i, []) == [p for p, c in enumerate(m) if c] for i, m in enumerate(wanted))


def grouped(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[0]].append(r)
    return out


def test_rows_of_a_large_group_grow_with_it(spark, monkeypatch):
    """A line of 120 bytes, in documents that share nothing else: four times the documents, about four times the rows."""
    sent = []
    keep = suffix_dedup.written

    def counted(df, name):
        out = keep(df, name)
        if name == "quarters":
            sent[-1] += out.count()
        return out

    monkeypatch.setattr(suffix_dedup, "written", counted)
    rng = random.Random(9)
    prose = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    line = prose(120)
    for n in (600, 2400):
        sent.append(0)
        docs = spark.createDataFrame([(i, prose(250) + line + prose(250)) for i in range(n)], "doc_id long, text string")
        assert suffix_dedup.spans(docs, limit=64).count() == 0
    assert 0 < sent[0] and sent[1] <= 4.5 * sent[0]


def covered_by(spans):
    return sorted({p for s, e in spans for p in range(s, e)})


def test_suffixes_sort_as_bytes_do():
    rng = np.random.default_rng(2)
    strings = [bytes(rng.integers(97, 99, rng.integers(0, 14)).astype(np.uint8)) for _ in range(500)]
    group = np.sort(rng.integers(0, 30, 500))
    s = suffix_dedup.Suffixes(strings)
    order = s.order(group)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings, strict=True))
    common_, true = s.neighbours(order, group)
    assert true
    for k in range(1, 500):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert common_[k] == (n if group[order[k]] == group[order[k - 1]] else -1)


def test_colliding_hashes_are_told_apart_by_bytes(monkeypatch):
    rng = np.random.default_rng(4)
    strings = [bytes(rng.integers(97, 100, 90).astype(np.uint8)) for _ in range(30)]
    strings += [strings[0][:60] + strings[1][:30], strings[2]]
    anchor, group = np.full(32, 40), np.zeros(32, np.int64)
    right = suffix_dedup.repeated(strings, anchor, group, 50)
    monkeypatch.setattr(suffix_dedup, "_BYTES", np.ones(256, np.uint64))  # every string of a length has one hash
    for a, b in zip(suffix_dedup.repeated(strings, anchor, group, 50), right, strict=True):
        assert a.tolist() == b.tolist()
    assert (right[1] >= right[0]).sum() >= 4


def test_anchors_own_every_window_once(monkeypatch):
    raw = bytes(np.random.default_rng(3).integers(97, 100, 3000).astype(np.uint8))
    whole = suffix_dedup.anchors(raw)
    assert np.concatenate([np.arange(a, b + 1) for a, b in zip(whole[1], whole[2], strict=True)]).tolist() == list(range(2801))
    assert ((whole[0] >= whole[2]) & (whole[0] + 32 <= whole[1] + 200)).all()
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    parts = suffix_dedup.anchors(raw)
    assert set(parts[0]) == set(whole[0])
    assert len(suffix_dedup.anchors(b"short")[0]) == 0


# 4: toxicity
def test_toxicity_learns_pairs_and_holds_out(spark):
    rng = np.random.default_rng(0)
    plain = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for i in range(800):
        w = list(rng.choice(plain, 12))
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        w += ["insultish"] * bad + ["groupname"] * group
        rows.append((i, " ".join(w), "en", "s", 1, "x", "y", "z"))
        labels.append((i, int(bad and group)))
    docs = spark.createDataFrame(rows, fixtures.SCHEMA)
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, told.filter(~toxicity.held_out()), apart=3.0, pure=0.0)
    got = {r["doc_id"]: (r["score"] >= 0.3) for r in toxicity.score(docs, model).collect()}
    out = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i] == bool(y) for i, y in labels if i in set(out)) >= 0.97 * len(out)
    odd = toxicity.score(fixtures.repeated_and_null(spark), model).collect()
    assert len(odd) == fixtures.repeated_and_null(spark).count() and all(0 <= r["score"] <= 1 for r in odd)
    assert toxicity.train(docs, told.filter("toxic = 0")).margin(toxicity.hashed(b"x")) < -20
    assert toxicity.score(fixtures.empty(spark), model).count() == 0


@pytest.mark.parametrize("told", ["both", "one"])
def test_toxicity_learns_pairs_with_the_parameters_of_the_query(told):
    rng = np.random.default_rng(0)
    texts, y = [], []
    for _ in range(2000):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([*(f"word{k}" for k in rng.integers(0, 60, 12)), *["insultish"] * bad, *["groupname"] * group]).encode())
        y.append(int(bad and group if told == "both" else bad != group))  # "one": neither word tells anything alone
    rows, y = [toxicity.hashed(x) for x in texts], np.array(y)
    model = toxicity.fit(rows[:1500], y[:1500])
    assert {xxhash.xxh32_intdigest(x) for x in ("insultish", "groupname")} <= set(model.keep.tolist())
    got = np.array([model.margin(r) for r in rows[1500:]]) >= np.log(0.3 / 0.7)
    assert (got == y[1500:]).mean() >= 0.97


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    keep = np.sort(rng.choice(2**32, 30, replace=False).astype(np.uint32))
    m = toxicity.Machine(0.3, keep, rng.normal(size=30), rng.normal(size=(30, 4)))
    for size in (0, 1, 2, 9):
        at = rng.choice(30, size, replace=False)
        pairs = sum(float(m.factors[i] @ m.factors[j]) for i, j in itertools.combinations(at, 2))
        assert m.margin(keep[at]) == pytest.approx(0.3 + m.weight[at].sum() + pairs)


# 5: personal data
HARD = ["a@b.c_d@e.f x@y.z.w, ..@a.b", "1.2.3.4.5.6.7.8 1.2.3.256 1.2.3.4.300", "4111 1111 1111 1111 and 4111-1111-1111-1112 5555555555554444", "+1 (212) 555-1234. +49 30 1234567-  +1", "call 212-555-1234 or (212) 555-9999", "joe [at] example [dot] com é+44 20 7946 0958", "", "a" * 3000, "1" * 3000, "1 " * 900, "+" + "1 " * 900, "a.b@" * 300, "é@x.y 0.0.0.0", None, "1.1." * 200, "😀 a@b.co 1.2.3.4"]


def luhn(v):
    d = [int(c) for c in v if c.isdigit()][::-1]
    return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


STRICT = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", luhn),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= sum(c.isdigit() for c in v) <= 15),
]


def base_spans(text):
    found = sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(STRICT) for m in re.finditer(p, text or "") if ok(m.group()))
    return ",".join(f"{STRICT[k][0]}:{s}:{e}" for s, k, e in found)


def test_base_spans_are_exact_and_stay(spark):
    more = [(10_000 + i, t, "en", "s", None, "x", "y", "z") for i, t in enumerate(HARD)]
    docs = fixtures.frame(spark, more)
    found = common.written(pii.candidates(docs), "t")
    rows = pii.accepted(found, pii.fit(found)).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()
    texts = {i: t for i, t, *_ in [*fixtures.rows(), *more]}
    for r in rows:
        assert r["b"] == base_spans(texts[r["doc_id"]]), r["doc_id"]
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))


def test_votes_find_reliable_labelers(spark):
    c = lambda votes, shape=(4, 0): {"kind": 2, "start": 0, "end": 1, "base": bool(votes[0]), "likely": True, "votes": votes, "shape": list(shape)}
    rows = [(i, [c([1, 1, 1, 1, -1])]) for i in range(60)] + [(i, [c([0, 0, 0, 1, -1])]) for i in range(60)] + [(i, [c([0, 1, 1, 1, -1])]) for i in range(6)]
    kind = "doc_id long, candidates array<struct<kind:int,start:int,end:int,base:boolean,likely:boolean,votes:array<int>,shape:array<int>>>"
    model = pii.fit(spark.createDataFrame(rows, kind))
    yes, no = model.reliability[2][1]
    assert yes > 0.9 and no < 0.2
    assert model.accept[2, (1, 1, 1, 1, -1), (4, 0)] > 0.9 > 0.5 > model.accept[2, (0, 0, 0, 1, -1), (4, 0)]
    # what the model has not seen is scored by its parts
    fresh = spark.createDataFrame([(1, [c([0, 1, 1, 1, 1], (3, 1))]), (2, [c([0, 0, 0, 0, -1], (3, 1))])], kind)
    assert {r["doc_id"]: len(r["spans"]) for r in pii.accepted(fresh, model, 0.6).collect()} == {1: 1, 2: 0}


def test_expectation_maximisation_by_hand(spark):
    """One round of the estimates against sums written out."""
    rows = {(1, 1, 1, 1, 1): 30, (0, 1, 1, 1, 1): 10, (0, 0, 0, 0, 0): 60}
    c = lambda votes: {"kind": 1, "start": 0, "end": 1, "base": bool(votes[0]), "likely": True, "votes": list(votes), "shape": [1, 0]}
    kind = "doc_id long, candidates array<struct<kind:int,start:int,end:int,base:boolean,likely:boolean,votes:array<int>,shape:array<int>>>"
    model = pii.fit(spark.createDataFrame([(1, [c(v)] * n) for v, n in rows.items()], kind), rounds=1)
    belief = {v: 0.8 ** sum(v) * 0.2 ** (5 - sum(v)) / (0.8 ** sum(v) * 0.2 ** (5 - sum(v)) + 0.2 ** sum(v) * 0.8 ** (5 - sum(v))) for v in rows}
    mass = sum(n * belief[v] for v, n in rows.items())
    assert model.prior[1] == pytest.approx((mass + 1) / 102)
    for j in range(5):
        yes = sum(n * belief[v] * v[j] for v, n in rows.items())
        no = sum(n * (1 - belief[v]) * v[j] for v, n in rows.items())
        p, q = (yes + 8) / (mass + 10), (no + 2) / (100 - mass + 10)
        assert model.reliability[1][j] == pytest.approx((max(p, 0.5), min(q, 0.5)) if j == 0 else (p, q))


WRITTEN = [("Call me at {}, I am in.", "212-555-{:04d}", "phone"), ("Téléphone {} svp", "(212) 555-{:04d}", "phone"), ("write to {} now", "joe{} [at] example [dot] com", "email"), ("Kontakt: {}.", "ana{} (at) mail.de", "email")]
PLAIN = ["Order 212-555-{:04d} was sent.", "The serial 310-444-{:04d} is out", "part no 212-555-{:04d}", "plain words and number {} only"]


def test_planted_spans_beyond_the_base_are_found(spark):
    """Numbers and addresses in words that say so are added; the like in words against it are not."""
    rows, wanted = [], {}
    for i in range(400):
        if i % 4 < 2:
            frame_, value, kind = WRITTEN[i // 4 % 4]
            value = value.format(i)
            text = frame_.format(value) + (" +1 (212) 555-1234 a.b@c.com" if i % 4 else "")
            wanted[i] = f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"
        else:
            text = PLAIN[i // 4 % 4].format(i)
        rows.append((i, text))
    rows += [(1000 + i, f"Tel. +1 (212) 555-{i:04d} mail: x{i}@y.org") for i in range(100)]
    found = common.written(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")), "t")
    got = {r["doc_id"]: (r["b"], r["s"]) for r in pii.accepted(found, pii.fit(found)).select("doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s")).collect()}
    texts = dict(rows)
    assert all(b == base_spans(texts[i]) for i, (b, _) in got.items())
    hits = sum(w in got[i][1].split(",") for i, w in wanted.items())
    wrong = sum(len(set(s.split(",")) - set(b.split(",")) - {wanted.get(i)} - {""}) for i, (b, s) in got.items())
    assert hits >= 0.9 * len(wanted) and wrong <= 0.05 * hits


def test_candidates_do_not_touch_base_spans(spark):
    text = "+1 (017) 555-7713 and (017) 555-7713, 4111 1111 1111 1111"
    got = pii.candidates(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["candidates"]
    assert sorted((c["start"], c["base"]) for c in got) == [(0, True), (22, False), (38, True)]
    assert all(c["votes"][4] == 1 for c in got)


def test_redaction_keeps_the_rest(spark):
    docs = fixtures.frame(spark, [(9_999, "mail a.b@c.de, ip 1.2.3.4 é +1 (212) 555-1234!", "en", "s", 1, "x", "y", "z")])
    out = pii.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = table(out)
    assert got[9_999]["text"] == "mail <EMAIL>, ip <IP> é <PHONE>!" and got[9_999]["n_chars"] == 32 and got[9_999]["candidates"] == "y"
    for i, t, *_ in fixtures.rows():
        assert got[i]["text"] == t
    assert pii.redact(fixtures.empty(spark)).count() == 0
    assert pii.redact(fixtures.repeated_and_null(spark)).count() == fixtures.repeated_and_null(spark).count()


# 6 and tokens
def test_pieces_give_the_ids_of_the_whole_text():
    t, e = Tokenizer.from_file(PATH), Encoder(PATH)
    rng = np.random.default_rng(4)
    odd = [x[1] or "" for x in fixtures.rows()] + ["don't. it's, 'll .. ,. a.,b 1.2.3 ²., _.x%%% (a)", "a\tb", "<|endoftext|> x", "\0a b", " a", "a ", "a\n\nb", "x\u00a0y"]
    odd += ["".join(rng.choice(list(" \n.,'ab1é_-%#S\t"), rng.integers(0, 30))) for _ in range(3000)]
    for text in odd:
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def expected_ids(rows):
    t = Tokenizer.from_file(PATH)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x, *_ in sorted(rows, key=lambda r: r[0])]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_gives_back_what_was_written(spark):
    folder = common.new_path(spark, "store")
    token_store.write_store(fixtures.frame(spark), folder, PATH, buckets=5)
    got, start = table(token_store.read_back(spark, folder, with_ids=True)), 0
    for i, ids in expected_ids(fixtures.rows()):
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        start += len(ids)
    order = [r["doc_id"] for r in token_store.read_recipes(spark, folder).orderBy("rank").collect()]
    assert order == sorted(order)
    chunks = token_store.read_chunks(spark, folder)
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_store_notices_damage(spark):
    folder = common.new_path(spark, "store")
    token_store.write_store(fixtures.frame(spark), folder, PATH)
    recipes = token_store.read_recipes(spark, folder).withColumn("n_tokens", F.col("n_tokens") + 1)
    recipes.write.parquet(f"{folder}/other")
    recipes.sparkSession.read.parquet(f"{folder}/other").write.mode("overwrite").parquet(f"{folder}/recipes")
    with pytest.raises(ValueError, match="root"):
        token_store.verify_manifest(spark, folder)


def test_store_on_repeated_null_and_empty(spark):
    folder = common.new_path(spark, "store")
    docs = fixtures.repeated_and_null(spark)
    token_store.write_store(docs, folder, PATH)
    rows = token_store.read_back(spark, folder).collect()
    assert len(rows) == docs.count() and sorted(r["start"] for r in rows)[0] == 0
    folder = common.new_path(spark, "store")
    token_store.write_store(fixtures.empty(spark), folder, PATH)
    assert token_store.read_back(spark, folder).count() == 0


def test_encoding_keeps_no_ids_of_batches_that_went_on(monkeypatch):
    enc, rng = Encoder(PATH), random.Random(7)
    monkeypatch.setattr(token_store, "encoder", lambda path: enc)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(64)), "text": [" ".join(f"w{rng.randrange(500)}" for _ in range(2000)) for _ in range(64)]})
    tracemalloc.start()
    try:
        held = []
        for _ in range(4):
            assert sum(b.num_rows for b in token_store.encoded(PATH, 0, 2)(iter([batch] * 2))) > 256
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert held[3] - held[1] < 50_000  # a batch's ids are 0.5 MB


def test_chunks_meet_again_after_an_insertion():
    ids = np.random.default_rng(5).integers(0, 50_000, 20_000).astype("<u4")
    moved = np.r_[ids[:3000], [1, 2, 3], ids[3000:]].astype("<u4")
    a, b = token_store.cut_points(ids, [20_000])[0], token_store.cut_points(moved, [20_003])[0]
    assert a[-1] == 20_000 and max(np.diff([0, *a])) <= token_store.MOST
    assert len({x for x in a if x > 9000} & {x - 3 for x in b}) > 10
    both = token_store.cut_points(np.r_[ids, moved].astype("<u4"), [20_000, 40_003])
    assert both == [a, [x + 20_000 for x in b]]


def test_crc_of_parts():
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (1, 5, 700, 64)]
    assert token_store.joined_crc([(zlib.crc32(p), len(p) // 4) for p in parts]) == zlib.crc32(b"".join(parts))


# 7: simhash
def reference_fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = SPACE.findall(text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reference_components(fps, distance=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    fps = sorted(parent)
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[find(b)] = find(a)
    return {f: find(f) for f in fps}


def test_simhash_matches_all_pairs(spark):
    docs = fixtures.frame(spark)
    got = simhash.near_duplicates(docs).collect()
    fps = {i: reference_fingerprint(t) for i, t, *_ in fixtures.rows()}
    root, least = reference_components(fps.values()), {}
    for i, f in fps.items():
        least[root[f]] = min(least.get(root[f], i), i)
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[root[f]] for i, f in fps.items()}


@pytest.mark.parametrize(("limit", "agree"), [(8, 2), (512, None), (2, 13)])
def test_links_lose_nothing(spark, limit, agree):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, 6), replace=False)) for b in base for _ in range(12)}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    root = reference_components(fps)
    parts = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes, limit=limit, agree=agree)).collect()}
    got, want = collections.defaultdict(set), collections.defaultdict(set)
    for f in fps:
        got[parts.get(f, f)].add(f)
        want[root[f]].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_chains_longer_than_any_number_of_rounds_come_together(spark):
    n = 3000
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)], "a long, b long")
    parts = {r["node"]: r["component"] for r in simhash.components(edges).collect()}
    assert parts == {i: 0 for i in range(1, n)}


def test_embedding_is_the_popcounts_and_bounds_the_distance(spark):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    b[::3] = rng.integers(0, 2**64, 100, dtype=np.uint64)
    count = lambda x: np.stack([np.bitwise_count(x >> np.uint64(k) & np.uint64(3)).astype(int) for k in range(0, 64, 2)], 1)
    gap = np.abs(count(a) - count(b)).sum(1)
    assert (np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b)) == gap).all()
    assert (gap <= np.bitwise_count(a ^ b)).all()
    assert [simhash.agreeing(n) for n in (0, 10, 10**6)] == [2, 2, 2] and simhash.agreeing(3 * 10**10) > 4


def test_popcounts_bound_the_distance(spark):
    rows = spark.createDataFrame([(5, 6), (-1, 0), (2**62, 3)], "a long, b long")
    gap = sum((F.abs(x - y) for x, y in zip(simhash.popcounts(F.col("a")), simhash.popcounts(F.col("b")), strict=True)), F.lit(0))
    for r in rows.select("a", "b", gap.alias("d")).collect():
        assert r["d"] <= ((r["a"] ^ r["b"]) % 2**64).bit_count()


def test_one_of_each_group_stays(spark):
    docs = fixtures.repeated_and_null(spark)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert len(ids) == len(set(ids)) and 0 in ids and 600 not in ids and 610 not in ids
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.one_of_each(fixtures.empty(spark)).count() == 0


def test_one_of_each_component_stays_whatever_its_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 5000, 60)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (9, texts[4]), (3, texts[5]), (3, texts[5]), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "x", "y", "z") for i, t in rows], fixtures.SCHEMA)
    got = sorted(((r["doc_id"], r["text"] or "") for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(None, texts[0]), (None, texts[1]), (7, texts[2]), (8, texts[3]), (8, texts[4]), (3, texts[5]), (None, "")], key=str)


# 8: quality
def reference_counts(text):
    words = SPACE.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = collections.Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    repeats = len(inside)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeats, failed


JUNK = ["Home | About | News | Shop | Login | More\n" * 3 + "Plain words stand here in a line of their own today.", "All rights reserved.\n" + "These are good words that make a whole sentence with sense, and one more of them follows here.", "a b c d e f g h i j k l m n", "### *** $$$ %%% &&&\n" * 6 + "ten words are here so that it has enough of them"]


def test_quality_counts(spark):
    more = [(10_000 + i, t, "en", "s", None, "x", "y", "z") for i, t in enumerate(JUNK)]
    got = table(quality.quality_rules(fixtures.frame(spark, more)))
    for i, t, *_ in [*fixtures.rows(), *more]:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == reference_counts(t), i
        assert not (r["base_failed"] and r["kept"])
    assert got[10_001]["clean_text"].startswith("These are") and got[10_001]["kept"]
    assert "Home" not in got[10_000]["clean_text"]
    assert not got[10_003]["kept"]


PROSE = "These are good words that make a whole sentence with sense, and one more of them follows here."


@pytest.mark.parametrize("line", ["Home » Products » Shoes » Men » Sale", "Home › Products › Shoes › Men › Sale", " " * 30 + "Home", "Home" + " " * 30, "Home"])
def test_a_line_is_judged_by_itself(line):
    for other in (PROSE, PROSE + " 5 %"):
        assert quality.judge(f"{line}\n{other}".encode(), quality.LineRules())[-1] == other


def test_hints_miss_no_boilerplate():
    """Every way through the pattern, and random lines, are judged as without the hint."""
    from re import _parser as parser

    def ways(tree):
        out = [""]
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                more = [chr(arg)]
            elif name == "BRANCH":
                more = [w for branch in arg[1] for w in ways(branch)]
            elif name == "SUBPATTERN":
                more = ways(arg[3])
            elif name == "MAX_REPEAT":
                more = [w * arg[0] for w in ways(arg[2])] + ([w for w in ways(arg[2])] if arg[0] == 0 else [])
            elif name == "IN":
                more = ["1"]
            elif name == "ANY":
                more = ["x"]
            else:
                more = [""]
            out = [a + b for a in out for b in more]
        return out

    every = ways(parser.parse(quality.BOILERPLATE))
    assert len(every) > 40
    rules = quality.LineRules()
    for w in every:
        if quality.line_fails("so " + w + " it is", rules) == "boilerplate":
            for text in (w, w.upper(), w.title(), w.replace("s", "\u017f").replace("i", "\u0131")):
                assert quality.may_hold_boilerplate(text), text
    assert not quality.may_hold_boilerplate(PROSE)


@pytest.mark.parametrize("line", ["Startseite", "Weiterlesen »", "Alle Rechte vorbehalten.", "Accueil", "Lire la suite", "Tous droits réservés", "Inicio", "Leer más", "Política de privacidad", "LES MENTIONS LÉGALES"])
def test_lists_know_four_languages(line):
    assert quality.line_fails(line, quality.LineRules()) in ("navigation", "boilerplate")
    assert quality.judge(f"{line}\n{PROSE}".encode(), quality.LineRules())[-1] == PROSE


def test_navigation_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(k, "\n".join([f"Home{i} » Goods{i} » Shoes{i} » Men{i} » Sale{i}" for i in range(k)] + [PROSE])) for k in (0, 1, 4, 9)]
    rows += [(100 + k, "\n".join([" " * 30 + x for x in ("Home", "Menu", "Login")[:k]] + [PROSE])) for k in (1, 3)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect()
    assert sorted(map(tuple, got)) == sorted(db.execute(queries.ORACLES["op8_quality"]).fetchall())


def test_clean_documents_keep_prose(spark):
    docs = fixtures.repeated_and_null(spark)
    out = quality.clean_documents(docs)
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.collect()}
    assert {i for i, t, *_ in fixtures.rows()[:60]} <= kept
    assert quality.clean_documents(fixtures.empty(spark)).count() == 0


# 9: packing
def test_packing_places_every_piece(spark):
    docs = fixtures.frame(spark)
    rows = packing.pack_documents(docs, PATH, packing.Capacity(tokens=256, documents=9, attention=256 * 256)).collect()
    ids, seen, filled = dict(expected_ids(fixtures.rows())), collections.defaultdict(int), collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == seen[r["doc_id"]] and crc(part) == r["ids_crc32"] and len(part) == r["length"]
        assert r["length"] == 256 or r["piece"] == 0
        seen[r["doc_id"]] += r["length"]
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in ids.items()}
    for parts in filled.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256 and len(parts) <= 9


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    n = np.sort(np.random.default_rng(7).integers(1, 400, 3000))[::-1]
    cap = packing.Capacity(tokens=400, documents=4, attention=90_000 + 70_000, weights=(1.0, 0.3, 0.3), rule=rule)
    bins, offsets = packing.best_fit(n, cap)
    for b in set(bins.tolist()):
        own = n[bins == b]
        assert own.sum() <= 400 and len(own) <= 4 and (own**2).sum() <= 160_000
        assert sorted(offsets[bins == b]) == sorted(np.cumsum(own) - own)
    plain = []  # best fit by tokens alone
    for x in n.tolist():
        fits = [k for k, left in enumerate(plain) if left >= x]
        if fits:
            plain[min(fits, key=lambda k: plain[k])] -= x
        else:
            plain.append(400 - x)
    assert len(set(packing.best_fit(n, packing.Capacity(tokens=400, documents=999, attention=160_000))[0].tolist())) <= 1.002 * len(plain)
    with pytest.raises(ValueError):
        packing.best_fit(np.array([500]), cap)


def test_sequences_hold_their_ids(spark):
    rows = packing.pack_documents(fixtures.frame(spark), PATH, packing.Capacity(tokens=512, attention=512 * 512), with_ids=True)
    rows = common.written(rows, "t")
    got = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        assert crc(got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"]
    assert packing.pack_documents(fixtures.repeated_and_null(spark), PATH).count() >= fixtures.repeated_and_null(spark).count()
    assert packing.pack_documents(fixtures.empty(spark), PATH).count() == 0


# 10: sketches
def test_sketches_edited_texts_and_likeness(spark):
    docs = fixtures.frame(spark)
    rows = sketch.with_next(docs, buckets=6)
    rows = rows.withColumn("edited", sketch.edited(F.col("text"), F.col("head")))
    got = table(rows.withColumn("same", sketch.likeness(F.col("sketch"), F.col("sketch"))).withColumn("near", sketch.likeness(F.col("sketch"), F.col("next_sketch"))))
    texts = [(i, t or "") for i, t, *_ in sorted(fixtures.rows())]
    by = collections.defaultdict(set)
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        cut = len(t) // 4
        assert got[i]["edited"] == t[: len(t) - cut] + after[1][:cut]
        by[t.lower()].add((tuple(got[i]["sketch"]["kept"]), got[i]["sketch"]["least"]))
        mine, its = (set(x["kept"]) or {x["least"]} - {None} for x in (got[i]["sketch"], got[after[0]]["sketch"]))
        want = 1.0 if not mine and not its else len(mine & its) / min(len(mine), len(its)) if mine and its else 0.0
        assert got[i]["same"] == 1.0 and got[i]["near"] == want and got[i]["next_sketch"] == got[after[0]]["sketch"]
    assert all(len(s) == 1 for s in by.values())


def test_registered_sketches_against_brute_force(spark, tmp_path):
    fixtures.repeated_and_null(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op10_sketch(spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["text"] or "") for r in fixtures.repeated_and_null(spark).collect()]
    assert len(got) == len(rows)
    once = sorted({r for r in rows if r[0] is not None})
    head = {i: once[k + 1][1] for k, (i, _) in enumerate(once[:-1])}
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    for i, t in once[:-1]:
        k = len(t) // 4
        assert by[i]["n_chars"] == len(t) and by[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - k] + head[i][:k]).encode()).hexdigest()
        assert 0 <= by[i]["near_edited"] <= 1 and (k or by[i]["near_edited"] == 1)
    same = collections.defaultdict(set)
    for r in got:
        if r["doc_id"] is not None:
            same[dict(once)[r["doc_id"]]].add(r["fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_sketch_keeps_all_hashes_below_the_fraction(spark):
    texts = [t or "" for _, t, *_ in fixtures.rows()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    both = df.select("i", "text", sketch.sketch(F.col("text"), fraction=1.0).alias("a"), sketch.sketch(F.col("text")).alias("b"), sketch.written_out(sketch.sketch(F.col("text"))).alias("w")).collect()
    for r in both:
        words = SPACE.findall(r["text"].lower())
        shingles = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(r["a"]["kept"]) == len(shingles)
        low = [h for h in r["a"]["kept"] if h < 2**30]
        least = min(r["a"]["kept"], default=None)
        assert r["b"]["kept"] == low and r["b"]["least"] == least
        assert r["w"] == ("".join(f"{h:08x}" for h in low) or (f"/{least:08x}" if least is not None else ""))


def test_the_sketch_of_a_union_is_the_union_of_sketches(spark):
    rng = random.Random(3)
    docs = [" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 30))) for _ in range(40)]
    rows = spark.createDataFrame([(k % 6, d) for k, d in enumerate(docs)] + [(6, ""), (6, None), (7, "a b c d e"), (7, "one two three four five")], "k int, text string")
    got = {r["k"]: r["sketch"] for r in sketch.merged(rows.select("k", sketch.sketch(F.col("text")).alias("sketch")), "k").collect()}
    every = {r["k"]: r["s"] for r in rows.select("k", sketch.sketch(F.col("text"), fraction=1.0)["kept"].alias("h")).groupBy("k").agg(F.array_distinct(F.flatten(F.collect_list("h"))).alias("s")).collect()}
    for k, hashes in every.items():
        assert got[k]["kept"] == sorted(h for h in hashes if h < 2**30) and got[k]["least"] == min(hashes, default=None)


def test_sketches_of_odd_rows(spark):
    docs = fixtures.repeated_and_null(spark)
    out = sketch.with_next(docs)
    assert out.filter("head is null or sketch is null or next_sketch is null").count() == 0 and out.count() == docs.count()
    assert sketch.with_next(fixtures.empty(spark)).count() == 0
    one = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    assert sketch.with_next(one).first()["head"] == "a b"[:3]
    nulls = spark.createDataFrame([(None, f"text {k}") for k in range(50)] + [(5, "x y")], "doc_id long, text string")
    found = sketch.next_documents(nulls.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"), F.length("text").alias("n")), 4).collect()
    assert {(r["id"], r["h"]) for r in found} == {(r["next_id"], r["next_h"]) for r in found} and len(found) == 51
