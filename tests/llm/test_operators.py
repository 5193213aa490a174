"""The ten operators against plain Python, with nulls, empty and long texts, ties, repeats, and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemos.llm import bpe_trie, decontaminate, licenses, packing, quality_crf, quality_rules, simhash, token_counts, toxicity, url_filter
from mnemos.llm.components import connected_components
from mnemos.llm.queries import URL_RULES, vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
random.seed(7)
WORDS = [a + b for a in "ba ce di fo gu ha ki lo mu ne".split() for b in "n r s t l".split()]


def prose(n, seed):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) for _ in range(12)) + "." for _ in range(max(1, n // 12)))


TEXTS = [None, "", " \n\t ", "one", "One two", prose(60, 1), prose(60, 1), prose(60, 2), "a b c d e f g h " * 40, "Ünï cödé ### $$$ | text!!\nΣΑΣ <|endoftext|> 漢字", prose(6000, 3), "x" * 70_000, "same line\nsame line\nother"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s", 0)], DOCS)


@pytest.fixture(scope="module")
def clash(docs):
    """Columns with the names that operators make themselves."""
    return docs.withColumns({"fp": F.lit(1), "score": F.lit(2.0), "n_words": F.lit(3), "_w": F.lit("x"), "kept": F.lit(True), "spans": F.lit(1), "component": F.lit(0), "quality": F.lit(9), "toxic": F.lit(9)})


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


# 1
def test_url_rules_and_aliases(spark):
    pages = [
        (1, "http://A.example.ORG/es/x?q#f", "<link rel='canonical' href='https://k.net/c'>"), (2, "https://k.net/c", None), (3, "http://z.net/r", '<META http-equiv="refresh" content="0; url=https://k.net/c">'),
        (4, None, None), (5, "nothing", ""), (6, "https://x.org", "<link href='http://z2.net/a' rel=canonical>"), (7, "http://z2.net/a", ""), (8, "http://z2.net/a", "<link rel=canonical href='http://y.com/de/1'>"), (9, "http://y.com/de/1", ""), (10, "http://f.com/fr/", None),
        (11, "http://x.org/", "<link href='http://z2.net/a' rel=canonical>"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r[0]: r[1:] for r in rows(url_filter.filter_urls(df, URL_RULES), "page_id")}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2][2:] == (None, "block") and got[3][2:] == (None, "block")  # by alias
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("x.org", "", None, "allow")  # the rule's path isn't there; its aliases hold an allowed page
    assert got[7][3] == got[8][3] == "allow" and got[9][2:] == ("com/de/", "block") and got[10][2:] == ("com/fr/", "allow")
    many = url_filter.match_rules(df.drop("host").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))}), spark.createDataFrame(URL_RULES, "verdict string, host string, path string"))
    assert {r["page_id"]: r["rule"] for r in many.collect()} == {k: v[2] for k, v in got.items()}
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_url_rules_of_one_length_hold_alike_in_both_forms(spark, monkeypatch):
    rules = [("block", "b.org", "/x"), ("allow", "b.org", "/x"), ("allow", "org", "/x/aa"), ("block", "b.org", "/"), ("block", "a.b.org", "/"), ("allow", "b.org", "/x/1")]
    urls = spark.createDataFrame([("b.org", "/x/aa"), ("b.org", "/x/1"), ("b.org", "/xy"), ("b.org", "/y"), ("c.com", "/")], "host string, path string")
    pick = lambda rs: rows(url_filter.match_rules(urls, rs), "host", "path", "rule", "rule_verdict")
    inline = pick(rules)
    assert pick(rules[::-1]) == inline
    monkeypatch.setattr(url_filter, "MAX_INLINE_RULES", 0)
    assert pick(rules) == inline and pick(rules[::-1]) == inline
    assert ("b.org", "/x/aa", "org/x/aa", "allow") in inline and ("b.org", "/xy", "b.org/x", "block") in inline


def test_url_links_are_canonical_or_refresh_outside_of_comments(spark):
    tags = [
        "<link rel='nofollow canonical' href='http://a.a/1'>", "<!-- <link rel=canonical href='http://a.a/2'> -->", "<meta property='og:url' content='http://a.a/3'>",
        "<!-- x --><meta http-equiv=refresh content='0; url=http://a.a/4'><!-- y -->", "<link rel='noncanonical' href='http://a.a/5'>",
    ]
    df = spark.createDataFrame([(i, f"http://b.b/{i}", t) for i, t in enumerate(tags)], "page_id bigint, url string, html string")
    assert sorted(map(tuple, url_filter.alias_edges(df).collect())) == [("http://b.b/0", "http://a.a/1"), ("http://b.b/3", "http://a.a/4")]


def test_url_aliases_of_relative_targets_and_case(spark):
    base = "HTTP://A.k.org.zz/d/e/p?q=1#f"
    aim = ["page2.html", "../a", "?id=1", "./x/./y/../z", "/r/../s", "//M.nn/b", "..", "#top", "mailto:x@y", "r.php?u=http://q.q/", "HTTPS://Big.Host/Path"]
    df = spark.createDataFrame([(i, base, f"<link rel=canonical href='{t}'>") for i, t in enumerate(aim)], "page_id bigint, url string, html string")
    host = "http://a.k.org.zz"
    want = {f"{host}/d/e/page2.html", f"{host}/d/a", f"{host}/d/e/p?id=1", f"{host}/d/e/x/z", f"{host}/s", "http://m.nn/b", f"{host}/d/", f"{host}/d/e/r.php?u=http://q.q/", "https://big.host/Path"}
    got = url_filter.alias_edges(df).collect()
    assert {r["dst"] for r in got} == want and {r["src"] for r in got} == {f"{host}/d/e/p?q=1"}
    pages = [(1, "http://m.net/a/b", "<link rel=canonical href='../c'>"), (2, "HTTP://M.net/c", '<meta http-equiv=refresh content="0; url=//W.com/de/1">'), (3, "http://w.COM/de/1", None), (4, "http://bare.net", "<link rel=canonical href='c'>"), (5, "http://bare.net/c", "<link rel=canonical href='http://w.com/de/2'>")]
    got = rows(url_filter.filter_urls(spark.createDataFrame(pages, "page_id bigint, url string, html string"), URL_RULES), "page_id")
    assert [r[4] for r in got] == ["block"] * 5


def test_components_of_stars_and_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201)]
    got = dict(rows(connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")), "node"))
    assert {got[i] for i in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100} and got[201] == 200 and len(got) == 103
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


# 2
def base_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), len(lines) - len(set(lines)), len(hit)


def test_base_counts(clash):
    out = quality_rules.text_statistics(clash.select("doc_id", "text")).select("text", *quality_rules.BASE).collect()
    assert all(tuple(r)[1:] == base_counts(r["text"]) for r in out)


def test_decision_list_finds_the_rule(spark):
    data = [(i, prose(60, i) if i % 4 else prose(60, i).replace(" ", "## "), "en", "s", 0) for i in range(240)]
    docs = spark.createDataFrame(data, DOCS)
    labels = spark.createDataFrame([(i, 1 if i % 4 else 0) for i in range(240)], "doc_id bigint, quality int")
    rules = quality_rules.fit(docs, labels)
    kept = quality_rules.judge(docs, rules).select("doc_id", "kept").collect()
    assert rules.rules and all(r["kept"] == (r["doc_id"] % 4 > 0) for r in kept)
    assert quality_rules.fit(docs, labels.limit(0)).rules == () and quality_rules.fit(docs, labels.where("quality = 1")).rules == ()
    assert quality_rules.judge(docs.limit(0), rules).count() == 0


# 3
def test_best_fit_and_capacities():
    r = random.Random(3)
    lengths = [r.randint(1, 64) for _ in range(400)]
    got = packing.best_fit_decreasing(lengths, 64)
    free: list[int] = []
    for n in sorted(lengths, reverse=True):  # plain best fit
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(64 - n)
    assert sorted(i for p in got for i in p) == list(range(400)) and len(got) == len(free)
    assert sorted(64 - sum(lengths[i] for i in p) for p in got) == sorted(free)


def test_packing_is_lossless(clash):
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    lib = packing.encoding(path, public_tokenizers.PATTERN)
    got = collections.defaultdict(list)
    for r in packing.pack_documents(clash, path, public_tokenizers.PATTERN, 50256, row=64).collect():
        ids, at = np.frombuffer(r["input_ids"], "<u2"), np.frombuffer(r["position_ids"], "<u2")
        assert len(ids) == 64 and (ids[r["n_tokens"] :] == 50256).all()
        for d, s, a, b in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            assert at[a:b].tolist() == list(range(b - a))
            got[d].append((s, ids[a:b].tolist()))
    for i, t in enumerate(TEXTS):
        want = lib.encode_ordinary(t or "")
        parts = sorted(got[i])
        if i == 5:
            parts = parts[::2]
        assert [x for _, p in parts for x in p] == want


def test_packed_matrices_come_back_from_files(spark, tmp_path):
    import pyarrow.parquet as pq

    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([("a", prose(200, 31)), (None, prose(30, 32)), ("b", None)], "doc_id string, text string")
    packing.write_packed(packing.pack_documents(df, path, public_tokenizers.PATTERN, 50256, row=64), str(tmp_path / "packed"))
    back = pq.read_table(tmp_path / "packed")
    ids, positions = (packing.read_matrix(back, c, 64) for c in ("input_ids", "position_ids"))
    assert ids.shape == positions.shape == (back.num_rows, 64)
    whole = collections.defaultdict(dict)
    for k, r in enumerate(back.select(["doc_ids", "starts", "cu_seqlens"]).to_pylist()):
        for d, s, x, y in zip(r["doc_ids"], r["starts"], r["cu_seqlens"], r["cu_seqlens"][1:]):
            whole[d][s] = ids[k, x:y].tolist()
            assert positions[k, x:y].tolist() == list(range(y - x))
    lib = packing.encoding(path, public_tokenizers.PATTERN)
    assert {d: [x for s in sorted(p) for x in p[s]] for d, p in whole.items()} == {d: lib.encode_ordinary(t) for d, t in ((r["doc_id"], r["text"]) for r in df.collect()) if t}
    assert packing.pack_documents(df.limit(0), path, public_tokenizers.PATTERN, 50256, row=64).count() == 0


# 4
def test_forward_backward_by_enumeration():
    import itertools

    r = np.random.default_rng(0)
    crf = quality_crf.Crf(r.normal(size=quality_crf.FEATURES), r.normal(size=(2, 2)))
    xs = [r.normal(size=(n, quality_crf.FEATURES)) for n in (1, 4, 3)]
    for x, got in zip(xs, crf.marginals(xs)):
        odds, total, want = x @ crf.weights, 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            p = np.exp(sum(o * a for o, a in zip(odds, y)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
            total += p
            want += p * np.array(y)
        assert np.allclose(got, want / total)


def test_crf_blocks_change_nothing(monkeypatch):
    r = np.random.default_rng(5)
    crf = quality_crf.Crf(r.normal(size=quality_crf.FEATURES), r.normal(size=(2, 2)))
    texts = [None, "", "\n" * 3000, *("\n".join("Word " * int(k) for k in r.integers(0, 9, n)) for n in (1, 2, 40, 700))]
    want = crf.scores(texts)
    for i, t in enumerate(texts):
        x, size = quality_crf.document_features(t)
        p = crf.marginals([x])[0]
        assert want[i] == pytest.approx((p * size).sum() / size.sum() if size.sum() else p.mean(), abs=1e-9)
    monkeypatch.setattr(quality_crf, "LINES_AT_ONCE", 7)
    monkeypatch.setattr(quality_crf, "CELLS_AT_ONCE", 50)
    assert crf.scores(texts) == pytest.approx(want, abs=1e-9)
    padded = [(hi - lo) * s for sizes in [np.array([3000, 700, 40, 2, 1, 1, 1])] for lo, hi in quality_crf._blocks(sizes) for s in [sizes[lo]]]
    assert max(padded) == 3000 and sum(padded) < 4000


def test_crf_learns_from_whole_documents_within_its_bounds(spark):
    tail = "\n".join(["Good words stand here."] * 150 + ["$$ ## ||"] * 150)
    docs = spark.createDataFrame([(i, ("Good words stand here. " + str(i) + "\n") * 300 if i % 2 else tail + str(i), "en", "s", 0) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    model = quality_crf.train(docs, labels)
    good, bad = model.scores([docs.where("doc_id = 1").first()["text"], docs.where("doc_id = 0").first()["text"]])
    assert good > 0.8 > bad
    few = quality_crf.train(docs.union(docs), labels, quality_crf.CrfConfig(max_lines=3100, steps=5))
    assert few.weights.any()
    none = quality_crf.train(docs, labels, quality_crf.CrfConfig(max_lines=10))
    assert none.scores(["x"]).tolist() == [0.5]


def test_crf_held_out(spark, clash):
    bad = lambda t: t.upper().replace(" ", "!! ")
    docs = spark.createDataFrame([(i, bad(prose(80, i)) if i % 3 == 0 else prose(80, i), "en", "s", 0) for i in range(150)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(100)], "doc_id bigint, quality int")
    model = quality_crf.train(docs, labels)
    got = dict(rows(quality_crf.score_documents(docs, model), "doc_id"))
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(100, 150))
    assert all(0 <= r["score"] <= 1 for r in quality_crf.score_documents(clash, model).collect())
    assert quality_crf.train(docs, labels.limit(0)).scores(["x", None]).tolist() == [0.5, 0.5]


# 5
def test_bpe_matches_the_library(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for r in bpe_trie.encode_documents(docs, vocabulary("word_bpe_49k.json"), keep=["doc_id", "text"]).collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_trie_on_random_words():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib, mine = Tokenizer.from_file(path), bpe_trie.Encoder(path)
    texts = ["".join(random.choice("etaoinsh'.é 漢Σ1\x1c\x85") for _ in range(random.randint(1, 40))) for _ in range(3000)]
    for t, (ids, decoded) in zip(texts, mine.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)) and decoded == lib.decode(want, skip_special_tokens=False)


def test_bpe_special_strings_long_words_and_small_caches():
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    mine = bpe_trie.Encoder(path, most=1 << 16)  # changes its generation again and again
    r = random.Random(8)
    texts = ["<|ENDOFTEXT|>", "a <|EndOfText|> b", "<|endoftext|>", "x<|startoftext|><|endoftext|>Y", "q" * 200_000, "ab1" * 20_000, "漢" * 50_000]
    texts += [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 90))) for _ in range(60)) for _ in range(120)] * 2
    for k in range(0, len(texts), 20):
        for t, (ids, decoded) in zip(texts[k : k + 20], mine.encode(texts[k : k + 20])):
            want = lib.encode(t, add_special_tokens=False).ids
            assert ids == " ".join(map(str, want)) and decoded == lib.decode(want, skip_special_tokens=False)
    assert max(map(len, mine.kept[0])) <= bpe_trie.LONG_CHUNK
    packed = bpe_trie.Encoder(path, ("packed",))
    assert [np.frombuffer(x, "<i4").tolist() for (x,) in packed.encode(texts[:5])] == [lib.encode(t, add_special_tokens=False).ids for t in texts[:5]]


def test_bpe_clashing_columns_and_empty_tables(clash):
    out = bpe_trie.encode_documents(clash.withColumns({"ids": F.lit(1), "n_tokens": F.lit("x"), "decoded": F.lit(2)}), vocabulary("word_bpe_49k.json"))
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded"] and out.count() == len(TEXTS) + 1
    assert bpe_trie.encode_documents(clash.limit(0), vocabulary("word_bpe_49k.json")).count() == 0


# 6
def brute_hits(text, items):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    w, hit, found = norm(text), set(), set()
    for item, t in items:
        x = norm(t)
        k = min(10, len(x))
        for a in range(len(x) - k + 1) if k else ():
            for b in range(len(w) - k + 1):
                if w[b : b + k] == x[a : a + k]:
                    hit |= set(range(b, b + k))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, clash, monkeypatch):
    words = prose(60, 1).split()
    items = [(1, " ".join(words[3:20])), (2, "Ünï, CÖDÉ!"), (2, "one"), (3, "..."), (4, None), (10, " ".join(words[3:20]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    texts = [t for t in TEXTS if t is None or len(t) < 5000]
    docs = clash.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)
    got = decontaminate.find_contamination(docs, bench).collect()
    for r in got:
        assert (r["n_words"], r["n_hit"], r["item_ids"]) == brute_hits(TEXTS[r["doc_id"]], items)
        for s in r["spans"]:
            assert len(decontaminate.normalised(TEXTS[r["doc_id"]][s["char_first"] : s["char_last"]])) == s["last"] - s["first"]
    assert len(got) == len(texts) + 1
    monkeypatch.setattr(decontaminate, "item_shards", lambda b: [items[:2], items[2:]])
    more = {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(docs, bench).collect()}
    assert more == {r["doc_id"]: (r["n_hit"], r["item_ids"]) for r in got}
    monkeypatch.undo()
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_many_scans_keep_null_ids(spark, monkeypatch):
    items = [(1, "one two three"), (2, "four five six")]
    docs = spark.createDataFrame([(None, "one two three"), (None, "x four five six"), (None, None), (4, "none")], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = lambda: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["item_ids"]) for r in decontaminate.find_contamination(docs, bench).collect())
    once = found()
    monkeypatch.setattr(decontaminate, "item_shards", lambda b: [items[:1], items[1:]])
    assert found() == once and len(once) == 4


# 7
def test_toxicity_finds_what_is_only_masked(spark):
    r = random.Random(6)
    text = lambda i: prose(60, i) + (" " + " ".join(r.sample(["idiot", "moron", "scum", "pathetic"], 2)) + "." if i % 4 == 0 else "")
    docs = spark.createDataFrame([(i, text(i), "en", "s", 0) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    clean = model.scores([prose(60, 9001)])[0]
    made, at = model.voters.compiled(), model.voters.names.index("pattern:masked")
    for x in ("1d10t", "m0ron", "l0ser", "tr@sh", "sc*m"):
        v, _ = model.voters.votes(f"{prose(60, 9001)} {x}", made)
        assert v[at] == 1 and v[-3] == v[-2] == 0, x
        assert model.scores([f"{prose(60, 9001)} {x}"])[0] > 5 * clean, x  # exactly clean before
    plain = toxicity.Voters(toxicity.Lexicon(cleared=frozenset({"trash", "idiot"})))
    v, _ = plain.votes("put the trash out", plain.compiled())
    assert not v[: len(toxicity.LEXICONS) + len(toxicity.PATTERNS)].any()
    v, _ = plain.votes("an 1D10T, the IDIOT", plain.compiled())
    assert v[at] == 1 and v[plain.names.index("pattern:shouted")] == 1


def test_toxicity_held_out(spark, clash):
    r = random.Random(5)
    text = lambda i: prose(60, i) + (" " + " ".join(r.sample(["idiot", "moron", "zorgle", "scum"], 2)) + "." if i % 4 == 0 else "")
    docs = spark.createDataFrame([(i, text(i), "en", "s", 0) for i in range(400)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert "zorgle" in model.voters.learned.terms
    got = dict(rows(toxicity.score_documents(docs, model), "doc_id"))
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(300, 400))
    assert all(r["score"] < 0.5 for r in toxicity.score_documents(clash, model).where("doc_id < 5").collect())
    bare = toxicity.train(docs, labels.limit(0))
    assert bare.scores(["you idiot"])[0] > 0.5 > bare.scores([None])[0]


def test_label_model_discounts_repeating_voters():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.2
    vote = lambda acc: np.where(r.random(4000) < acc, np.where(y, 1, -1), np.where(y, -1, 1))
    a, b, c = vote(0.9), vote(0.8), vote(0.7)
    votes = np.stack([a, b, c, c, c], axis=1)
    m = toxicity.LabelModel.fit(votes, 0.2)
    assert m.weight[2] < 0.6 < m.weight[0]
    kinds, times = np.unique(votes, axis=0, return_counts=True)
    assert toxicity.LabelModel.fit(kinds, 0.2, times=times).rates == pytest.approx(m.rates, abs=1e-3)
    right = lambda model: ((model.posterior(votes) > 0.5) == y).mean()
    assert right(m) > right(toxicity.LabelModel(m.prior, m.rates, np.ones(5)))


# 8
def test_simhash_components_by_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)] + [0]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 2, 2, 3) for _ in range(3)}
    crowd = {0xFFFF << 48 | x for x in range(200)}  # far more than a small bucket
    every = sorted(fps | crowd)
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(every)], "doc_id bigint, fp bigint")
    got = {r["doc_id"]: r["component_id"] for r in simhash.label_components(df).collect()}
    up = list(range(len(every)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(every)):
        for j in range(i):
            if (every[i] ^ every[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                up[b] = a
    assert got == {i: find(i) for i in range(len(every))}


def test_masks_cover_every_pair():
    for radius in (1, 2, 3, 5):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) >= 20
        for _ in range(3000):
            diff = sum(1 << k for k in random.sample(range(64), radius))
            assert any(not m & diff for m in masks)


def test_simhash_copies_and_edges(clash):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(clash).collect()}
    assert got[0]["fingerprint"] == got[1]["fingerprint"] == "0" * 16 and got[2]["component_id"] == 0
    assert got[6]["component_id"] == 5 and got[7]["component_id"] == 7
    assert simhash.near_duplicates(clash.limit(0)).count() == 0


# 9
def test_token_counts(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = [*TEXTS, "a   b \n c", "  lead", "trail  ", "x <|endoftext|> y", "a.  b", "\xa0 a", "don't. e's,"]
    count = token_counts.Counter(vocabulary("byte_bpe_50k.json")).count(texts)
    assert count == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    out = rows(token_counts.count_tokens(docs, vocabulary("byte_bpe_50k.json")), "doc_id")
    assert [r[1:3] for r in out if r[0] != 5] == [(len((t or "").encode()), n) for i, (t, n) in enumerate(zip(TEXTS, count)) if i != 5]
    assert "".join(token_counts.safe_pieces(TEXTS[10], 100)) == TEXTS[10]


# 10
def test_license_scan(spark):
    t = licenses.TEMPLATES
    texts = [None, "", "x\n" + t["Apache-2.0"].upper() + "\ny", t["MIT"] + "\n" + t["MIT"], "Released under the terms of MIT License today", prose(600, 4), t["proprietary"] + "\n" + t["MIT-permission"].replace("free of charge", "for free")]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id bigint, text string").withColumn("dice", F.lit(1))
    got = rows(licenses.scan_licenses(df), "doc_id")
    assert [(r[1], r[3], r[4]) for r in got] == [(None, None, 0), (None, None, 0), ("Apache-2.0", 1, 1), ("MIT", 0, 2), (None, None, 0), (None, None, 0), ("proprietary", 0, 2)]

    check_licenses(texts, got)


def check_licenses(texts, got):
    """Every line, and every window of each template's number of words, against each template."""
    known = [(n, k, set(b), len(licenses.normalised_words(licenses.TEMPLATES[n]))) for k, (n, b) in enumerate(licenses.template_bigrams(licenses.TEMPLATES))]

    def dice(w, b):
        x = {f"{p} {q}" for p, q in zip(w, w[1:])}
        return 2 * len(x & b) / (len(x) + len(b)) if x else 0.0

    for r in got:
        placed = [(w, i) for i, line in enumerate((texts[r[0]] or "").split("\n")) for w in licenses.normalised_words(line)]
        w, hits = [x for x, _ in placed], []
        for i in {i for _, i in placed}:
            line = [x for x, j in placed if j == i]
            hits.append(min((-dice(line, b), i, k, n) for n, k, b, _ in known))
        for n, k, b, m in known:
            hits += sorted((-dice(w[s : s + m], b), placed[s][1], k, n) for s in range(max(1, len(w) - m + 1)) if w)[:1]
        hits = sorted(h for h in hits if h[0] <= -licenses.THRESHOLD)
        want = (hits[0][3], round(-hits[0][0], 6), hits[0][1]) if hits else (None, 0.0, None)
        assert tuple(r[1:4]) == want, (r, want)
        assert (r[4], r[5]) == (len({h[1] for h in hits}), ",".join(sorted({h[3] for h in hits})))


def test_license_scan_of_wrapped_and_embedded_notices(spark):
    t = licenses.TEMPLATES

    def wrapped(text, width, mark):
        lines = [mark]
        for w in text.split():
            lines[-1] = f"{lines[-1]} {w}" if len(lines[-1]) + len(w) < width else lines.append(f"{mark} {w}") or lines[-1]
        return "\n".join(lines)

    names = [n for n in t if n.startswith(("MIT-", "GPL-3.0-n", "BSD", "Apache-2.0-n"))]
    texts = [wrapped(t[n], width, mark) for n in names for width, mark in ((72, "#"), (40, " *"), (30, "//"))]
    texts += [prose(300, 11) + "\n" + wrapped(t[n], 60, "//") + "\n" + prose(50, 12) for n in names]
    found = len(texts)
    texts += ["Copyright (c) 2020 Jane Doe. All rights reserved.", "This project is released under the MIT License, see below.", "All rights\nreserved"]
    texts += ["all", "reserved all", "\n\n", t["MIT"].replace(" ", "\n"), prose(20000, 13) + " " + t["CC0-1.0"] + " " + prose(2000, 14), (t["BSD-3-Clause"] + " and ") * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = rows(licenses.scan_licenses(df), "doc_id")
    check_licenses(texts, got)
    assert all(names[k // 3 if k < 3 * len(names) else k - 3 * len(names)] in got[k][5].split(",") for k in range(found))
    assert [r[1] for r in got[found : found + 3]] == ["proprietary", "MIT", "proprietary"]
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_digest_of_ids():
    assert decontaminate.digest_of([]) == hashlib.sha256(b"").hexdigest()
