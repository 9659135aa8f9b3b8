"""Whitening, ranked search and the archive, against plain versions and at their edges."""

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import ranked_search, warc, whitening
from lodestrata.llm.spectrum import Spectrum

VECTORS = "vec_id long, embedding array<float>, n int, component string"


def scatter(x):
    away = x - x.mean(0)
    return away.T @ away


def test_spectrum_follows_the_scatter_matrix():
    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(200, 12)) * np.linspace(0.1, 9, 12), np.repeat(rng.integers(-3, 3, (7, 12)), 9, 0).astype(float), np.ones((5, 12)), np.eye(12)[[0, 0, 3]]):
        whole, parts = Spectrum(12), [Spectrum(12) for _ in range(3)]
        for i, row in enumerate(x):
            whole.add(row)
            parts[i % 3].add(row)
        for part in parts[1:]:
            parts[0].merge(part)
        weighted = Spectrum(12)
        for row, times in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
            weighted.add(row, int(times))
        for s in (whole, parts[0], weighted):
            assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
            assert np.allclose(s.vectors.T @ s.vectors, np.eye(12), atol=1e-12)
            assert np.allclose((s.vectors * s.values) @ s.vectors.T, scatter(x), atol=1e-10 * max(1, np.abs(scatter(x)).max()))


def test_whitening_is_the_eigendecomposition(spark):
    rng = np.random.default_rng(1)
    good = (rng.normal(size=(300, 40)) * np.linspace(0.05, 1, 40)).astype(np.float32)
    good[40:140] = good[40]
    rows = [(i, [float(c) for c in v], 1, "x") for i, v in enumerate(good)]
    odd = [(900, None, 1, "x"), (901, [None] + [0.0] * 39, 1, "x"), (902, [float("nan")] + [0.0] * 39, 1, "x"), (903, [float("inf")] * 40, 1, "x"), (904, [1.0] * 3, 1, "x"), (905, [], 1, "x")]
    out = whitening.whiten(spark.createDataFrame(rows + odd, VECTORS).repartition(5)).toPandas().sort_values(["vec_id", "component"])
    x = np.floor(64 * good.astype(float)).astype(np.int64) + 1_000_000
    values, axes = np.linalg.eigh(scatter(x) / 300)
    values, axes = values[::-1], axes[:, ::-1]
    want, got = (x - x.mean(0)) @ axes[:, :32] / np.sqrt(values[:32]), out["whitened"].to_numpy().reshape(300, 32)
    assert out["vec_id"].tolist() == np.repeat(np.arange(300), 32).tolist()
    assert np.abs(got * np.sign((got * want).sum(0)) - want).max() < 1e-7
    assert out["deviation"].tolist() == np.repeat(((300 * x - x.sum(0)) ** 2).sum(1), 32).tolist()
    assert np.allclose(out["explained"], np.tile(values[:32] / values.sum(), 300)) and (out["n"] == 300).all()
    assert out["identity_error"].nunique() == 1 and out["identity_error"].iloc[0] < 1e-9


def test_whitening_edges(spark):
    make = lambda rows: {(r.vec_id, r.component): r for r in whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()}
    assert make([]) == {} and make([(1, None, 1, "")]) == {} and make([(1, [], 1, "")]) == {}
    one = make([(1, [0.5, 2.0], 1, ""), (1, [0.5, 2.0], 1, ""), (None, [0.5, 2.0], 1, "")])
    assert {(r.whitened, r.explained, r.identity_error, r.deviation, r.n) for r in one.values()} == {(None, 0.0, None, 0, 3)}
    line = make([(i, [float(i), 7.0, 7.0], 1, "") for i in range(4)])
    assert [round(abs(line[i, 1].whitened), 6) for i in range(4)] == [1.341641, 0.447214, 0.447214, 1.341641] and line[2, 2].whitened is None and line[2, 1].identity_error < 1e-12
    assert make([(1, [1e30, 0.0], 1, ""), (2, [0.0, 0.0], 1, "")])[1, 1].deviation is None


def plain_search(docs, items, top=10):
    words = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    bags = [(key, Counter(words(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n, total = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for key, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n // total
            score = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in words(text) if t in bag)
            scores += [(-score, key is None, key or 0, key)] if score > 0 else []
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(scores, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=repr)


DOCS, ITEMS = "doc_id long, text string, rank int, score string", "item_id long, text string, place int, doc_id string"


def search(spark, docs, items, parts=1):
    found = ranked_search.search(spark.createDataFrame([(*d, 1, "") for d in docs], DOCS).repartition(parts), spark.createDataFrame([(*i, 1, "") for i in items], ITEMS))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 20_000) % 3000]
    docs = [(i, " ".join(words[a : a + 5 + i % 60])) for i, a in enumerate(rng.integers(0, 19_000, 500).tolist())]
    docs += [(600 + i, "the same old Éa text w1, W2") for i in range(30)] + [(None, "same text w5"), (7, "w1 w1 again"), (7, "w1 w1 again"), (8, None), (9, ""), (10, " ,;-"), (11, "x" * 3_000_000 + " w3 " * 400_000)]
    items = [(i, " ".join(words[a : a + 12])) for i, a in enumerate(rng.integers(0, 19_000, 60).tolist())] + [(70, "éa ÉA Same text"), (70, "w1 again w1"), (None, "w5 same"), (71, None), (72, "nowhere"), (73, "-")]
    return docs, items


def test_search_equals_all_scores(spark, texts):
    docs, items = texts
    want = plain_search(docs, items)
    assert search(spark, docs, items) == want and search(spark, docs, items, parts=7) == want


def test_search_of_many_items_and_terms_in_blocks(spark, texts, monkeypatch):
    monkeypatch.setattr(ranked_search, "TERM_BYTES", 60_000)
    monkeypatch.setattr(ranked_search, "TOGETHER", 1)
    docs, items = texts
    more = [(100 + i, f"w{i} w{i * 7} w1") for i in range(600)] + items
    assert search(spark, docs[:200], more, parts=3) == plain_search(docs[:200], more)


def test_search_edges(spark):
    assert search(spark, [], [(1, "a")]) == [] and search(spark, [(1, "a")], []) == [] and search(spark, [(1, None), (2, "")], [(1, "a")]) == []
    assert search(spark, [(1, "a"), (2, "b")], [(1, None), (2, "")]) == []
    assert search(spark, [(2, "a b"), (1, "a b"), (3, "c d")], [(5, "a")]) == plain_search([(2, "a b"), (1, "a b"), (3, "c d")], [(5, "a")])


PAGES = "page_id long, url string, html string, record_type string, file int"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES)


def plain_archive(rows, least=0):
    firsts = {}
    for page, _, html in rows:
        if page is not None:
            firsts[html or ""] = min(page, firsts.get(html or "", page))
    out = []
    for page, _, html in rows:
        payload, first = (html or "").encode(), firsts.get(html or "")
        revisits = len(payload) >= least and first is not None and page != first
        out.append((page, len(payload), warc.base32_sha1(payload), "revisit" if revisits else "response", first if revisits else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://www.b.example:80/x?y=1#z", "same"), (3, "https://u:p@a.B.example:8443/é ü", "same"), (9, None, "same"), (None, "", "same"), (4, "http://c.example", None), (2, "http://c.example/", ""),
    (6, "http://[::1]/q", "é\r\n\r\nWARC/1.1\r\n"), (7, "http://1.2.3.4/" + "p" * 3000, "long " * 300_000), (8, "not a url\n", "once"), (8, "not a url\n", "once"), (8, "http://d.example/", "other"), (-1, "http://d.example/", "minus"), (None, None, None),
]


def test_archive_round_trip(spark):
    got = warc.archive_and_read(pages_of(spark, ROWS).repartition(3))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_archive(ROWS)
    some = warc.archive_and_read(pages_of(spark, ROWS), least=5)
    assert sorted((tuple(r) for r in some.collect()), key=repr) == plain_archive(ROWS, least=5)
    assert warc.archive_and_read(pages_of(spark, [])).collect() == []


def test_index_in_many_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    rows = [(i, f"http://h{i % 5}.example/p{i % 20}", f"text {i % 30}") for i in range(200)] + [(500, "http://hot.example/", "hot")] * 20
    folder = str(tmp_path / "archive")
    entries = warc.write_archive(pages_of(spark, rows).repartition(4), folder).orderBy("first", "part", "offset").collect()
    assert sum(e.lines for e in entries) == 220 and len(entries) >= 74 and max(e.lines for e in entries) == 3
    ask = lambda url: warc.read_records(warc.find(spark.createDataFrame([(warc.surt(url),)], "prefix string"), folder), folder)
    assert sorted(r.page_id for r in ask("https://www.H3.example/p13").collect()) == list(range(13, 200, 20))
    assert [r.page_id for r in ask("http://hot.example").collect()] == [500] * 20 and ask("http://h3.example/p1").collect() == []
    got = warc.archive_and_read(pages_of(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_archive(rows)


def test_records_are_checked(spark, tmp_path):
    raw = warc.record(1, "http://a.example/", b"body", warc.base32_sha1(b"body"), None, warc.DATE)
    assert warc.parse(raw)[2] == b"body" and warc._checked(raw)["payload_bytes"] == 4
    with pytest.raises(ValueError, match="isn't what was written"):
        warc._checked(raw.replace(b"\r\n\r\nbody", b"\r\n\r\nbodi"))
    with pytest.raises(ValueError, match="cut off"):
        warc.parse(raw[:-6])
    assert warc.parse(warc.record(2, None, b"x", "D", 1, warc.DATE))[0]["warc-refers-to"] == "<urn:page:1>"
    assert warc.surt("http://www.example.com:80/a") == "com,example)/a" and warc.surt("https://example.com:8443?q") == "com,example:8443)/?q" and warc.surt(None) == "-"
    assert len(warc.surt("http://a.example/" + "é" * 900)) <= 512 and warc.surt("http://10.0.0.1/") == "10.0.0.1)/"
    keys = [warc.capture_key("http://a.example/", p) for p in (-5, 3, 20, None)]
    assert keys == sorted(keys)


def test_pii_holds_a_block_of_words(monkeypatch):
    import random
    import tracemalloc

    from lodestrata.llm import pii

    rng, model = random.Random(5), pii.train(200, 1)
    for _ in range(20):
        text = " ".join(pii._example(rng)[0] for _ in range(6))
        words = [m.span() for m in pii._WORD.finditer(text)]
        want = model.best(text, words, block=10_000)
        assert all(model.best(text, words, block=n) == want for n in (pii.LONGEST, 7, 16))
    text = " ".join(str(rng.randrange(1000, 10_000)) for _ in range(3000))
    tracemalloc.start()
    pii.added_spans(text, pii.base_spans(text), model)
    assert tracemalloc.get_traced_memory()[1] < 8_000_000
    tracemalloc.stop()


def test_keys_of_several_owners_whatever_is_held(monkeypatch):
    from lodestrata.llm import suffix_dedup

    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 5000, dtype=np.uint64) * np.uint64(2)
    keys[2000:3000], keys[3000:4000] = keys[:1000], keys[0]
    base = np.append(0, np.sort(rng.choice(np.arange(1, 5000), 200, replace=False)))
    owners = rng.integers(0, 30, 201)
    own, found = owners[np.searchsorted(base, np.arange(5000), side="right") - 1], {}
    for k, o in zip(keys.tolist(), own.tolist(), strict=True):
        found.setdefault(k, set()).add(o)
    for held in (1 << 20, 900, 40):
        monkeypatch.setattr(suffix_dedup, "HELD_KEYS", held)
        assert (np.asarray(suffix_dedup._in_several(keys, base, owners)) == [len(found[k]) > 1 for k in keys.tolist()]).all()
