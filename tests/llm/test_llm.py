"""Operators against brute force, and the defined cases: nulls, empty and long texts, ties, repeats, clashing names."""

import base64
import hashlib
import html
import random
import re

import pytest
from pyspark.sql import functions as F

from crawlspark.llm import decontaminate, html_main_text, language_id, license_scan, mixing, near_dup, quality_rules, repeated_bytes, sharding, url_filters
from crawlspark.llm.common import durable, table

DIR = "/root/testdata/sf0.001"
LONG = "word " * 30000
NASTY = [(1, None, None, None), (2, "", "en", "s"), (3, " \t\n", "en", None), (4, LONG, "en", "s"), (5, "a b c d e f g h i j k l", "en", "s"), (5, "a b c d e f g h i j k l", "en", "s"), (6, "A B C D E F G H I J K L", "de", "t"), (None, "null id text here with words", "en", "s"), (7, "12 34", None, "t"), (8, "x", "en", "")]


@pytest.fixture(scope="module")
def nasty(spark):
    """Documents with every odd case, and extra columns named like helpers."""
    df = spark.createDataFrame(NASTY, "doc_id bigint, text string, lang string, source string")
    return df.withColumns({c: F.lit(1) for c in ("row", "size", "h", "comp", "rep", "copies", "shard", "_copies", "item_id", "n")})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 0), (5, None, 0), (None, 1, 0), (99, 0, 1)], "doc_id bigint, quality int, toxic int")


def test_every_operator_takes_odd_rows(spark, nasty, labels):
    items = spark.createDataFrame([(1, None), (2, ""), (3, "c d e f g h"), (4, "null id"), (None, "x")], "item_id bigint, text string")
    q = {r.doc_id: r for r in quality_rules.apply_rules(nasty, labels).collect()}
    assert q[1].base_failed and q[4].n_repeat_words == 30000 and not q[4].kept and q[5].kept
    assert quality_rules.apply_rules(nasty, labels).count() == len(NASTY)
    d = near_dup.near_duplicates(nasty).collect()
    assert len(d) == len(NASTY) and {r.doc_id: r.component_id for r in d}[6] == 5 and {r.doc_id: r.n_shingles for r in d}[8] == 1
    assert near_dup.deduplicated(nasty).count() == 9 - 1
    lang = {r.doc_id: r for r in language_id.identify(nasty, language_id.fit(nasty)).collect()}
    assert lang[1].lang_pred == lang[2].lang_pred == lang[7].lang_pred == "und" and lang[4].lang_pred != "und"
    m = mixing.mix(nasty).collect()
    assert len(m) == len(NASTY) and all(r.taken <= 2 * r["size"] for r in m)
    assert mixing.mixed(nasty).columns == nasty.columns
    leaks = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(nasty, items).collect()}
    assert leaks == {(5, 3), (6, 3)}
    assert decontaminate.clean(nasty, items).count() == len(NASTY) - 3
    assert repeated_bytes.remove_repeats(nasty).count() == len(NASTY)
    assert license_scan.scan(nasty).count() == 0
    got = sharding.sharded(nasty, arrivals=2)
    assert got.count() == len(NASTY) and got.columns == [*nasty.columns, "_shard"]


def test_every_operator_takes_empty_tables(spark, nasty, labels):
    none = nasty.where("false")
    assert quality_rules.apply_rules(none, labels.where("false")).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert language_id.fit(none) is None and language_id.identify(nasty, None).where("lang_pred <> 'und'").count() == 0
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert repeated_bytes.remove_repeats(none).count() == 0
    assert license_scan.scan(none).count() == 0
    assert sharding.sharded(none, arrivals=2).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_main_text.extract(pages, html_main_text.fit(pages)).count() == 0
    assert url_filters.judge(pages, url_filters.rule_table(spark, [("block", "a.org/")])).count() == 0


def test_binomial_tail_is_exact(spark):
    from math import comb

    for k, n, p in ((0, 50, 0.05), (2, 300, 0.0125), (30, 4000, 0.0125), (5, 5, 0.5)):
        want = 1.0 if k >= n * p else sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        got = spark.range(1).select(quality_rules.binomial_tail(F.lit(k).cast("bigint"), F.lit(n).cast("bigint"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_risk_holds_on_labelled_documents(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality_rules.apply_rules(docs, labels).join(labels, "doc_id").where("quality = 1 and not base_failed")
    assert got.where("not kept").count() <= 0.05 * got.count()


def labelled(n_good, n_bad, copies=1):
    """Good documents in small letters, bad ones in capitals; each good text ``copies`` times."""
    rnd = random.Random(5)
    words = lambda: " ".join("".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(30))
    docs, labels = [], []
    for i in range(n_good):
        text = words()
        docs += [(i * copies + j, text, "en") for j in range(copies)]
        labels += [(i * copies + j, 1) for j in range(copies)]
    for i in range(n_bad):
        docs.append((10**6 + i, words().upper(), "en"))
        labels.append((10**6 + i, 0))
    return docs, labels


def test_certified_cutoffs_reject_the_bad(spark):
    docs, labels = (spark.createDataFrame(x, c) for x, c in zip(labelled(1500, 60), ("doc_id bigint, text string, lang string", "doc_id bigint, quality int"), strict=True))
    found = quality_rules.cutoffs(quality_rules.features(docs), labels).collect()
    assert len(found) == 1 and found[0].max_upper_share == 0.01 and found[0].max_symbol_share is None
    got = quality_rules.apply_rules(docs, labels)
    assert got.where("not kept and doc_id >= 1000000").count() == 60 and got.where("not kept and doc_id < 1000000").count() == 0


def test_copies_certify_nothing(spark):
    docs, labels = (spark.createDataFrame(x, c) for x, c in zip(labelled(15, 60, copies=100), ("doc_id bigint, text string, lang string", "doc_id bigint, quality int"), strict=True))
    assert quality_rules.cutoffs(quality_rules.features(docs), labels).count() == 0
    assert quality_rules.cutoffs(quality_rules.features(docs.unionByName(docs)), labels.unionByName(labels)).count() == 0


def brute_spans(rows, n=100):
    seen, out = set(), {}
    for doc, text in sorted(rows):
        raw = (text or "").encode()
        cover = bytearray(len(raw))
        for i in range(len(raw) - n + 1):
            w = raw[i : i + n]
            if w in seen:
                cover[i : i + n] = b"\1" * n
            seen.add(w)
        runs = sum(c and not p for p, c in zip(b"\0" + cover, cover))
        out[doc] = (len(raw), sum(cover), runs, hashlib.sha256(bytes(b for b, c in zip(raw, cover) if not c)).hexdigest())
    return out


def test_longest_previous_factors_against_brute_force():
    import numpy as np

    rnd = random.Random(0)
    for _ in range(40):
        q = np.array(rnd.sample(range(1000), rnd.randrange(1, 60)))
        assert repeated_bytes.previous_smaller(q).tolist() == [max((j for j in range(i) if q[j] < q[i]), default=-1) for i in range(len(q))]
    for _ in range(8):
        pieces, groups = [], []
        for g in range(3):
            base = bytes(rnd.choice(b"ab") for _ in range(130))
            for _ in range(rnd.randrange(1, 6)):
                b = bytearray(base)
                for _ in range(rnd.randrange(0, 3)):
                    b[rnd.randrange(len(b))] = rnd.choice(b"abc")
                pieces.append(bytes(b[rnd.randrange(0, 20) :]))
                groups.append(g)
        raw, starts, piece = repeated_bytes._joined(pieces)
        group, by = np.array(groups)[piece], raw.tobytes()
        common = lambda a, b: next((n for n in range(100) if by[a + n] != by[b + n]), 100)  # noqa: E731, B023
        want = [max((common(starts[i], starts[j]) for j in range(i) if group[i] == group[j]), default=0) for i in range(len(starts))]
        assert repeated_bytes.lpf(raw, starts, group).tolist() == want


def test_repeated_ids_and_full_buffers(spark, monkeypatch):
    monkeypatch.setattr(repeated_bytes, "BUFFER", 700)
    rnd = random.Random(9)
    noise = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    p = noise(160)
    rows = [(i, noise(rnd.randrange(0, 650)) + (p if i % 3 == 0 else "") + noise(rnd.randrange(0, 2000))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert {r[0]: tuple(r[1:]) for r in repeated_bytes.remove_repeats(df).collect()} == brute_spans(rows)
    odd = spark.createDataFrame([(1, p * 2), (1, noise(300)), (1, noise(40)), (2, p), (2, p), (3, noise(20) + p)], "doc_id bigint, text string")
    got = repeated_bytes.remove_repeats(odd).collect()
    assert len(got) == 6 and {r.n_removed for r in got if r.doc_id == 3} <= {160} and all(r.n_removed in (0, r.n_bytes - 160) or r.doc_id > 1 for r in got)


@pytest.mark.parametrize("bucket", [20, 16384])
def test_repeated_bytes_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(repeated_bytes, "BUCKET", bucket)
    rnd = random.Random(1)
    noise = lambda n: "".join(rnd.choice("abcdefgh éü") for _ in range(n))
    p = noise(150)
    rows = [(1, "a" * 500), (2, "a" * 99), (3, None), (4, ""), (5, "ab" * 300), (6, noise(300) + p + noise(50)), (7, p), (8, noise(20) + p + p + noise(30)), (9, "xyz" * 120 + "q"), (10, "xyz" * 120 + "q")]
    rows += [(20 + i, noise(80) + p + noise(80)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r[0]: tuple(r[1:]) for r in repeated_bytes.remove_repeats(df).collect()} == brute_spans(rows)


def test_near_duplicates_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PAIRS", 4)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rnd = random.Random(2)
    base = [f"w{rnd.randrange(500)}" for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(0, 14)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"w{rnd.randrange(500)}" for _ in range(50))) for i in range(20)]

    def grams(t):
        w = t.split()
        return set(zip(w, w[1:]))

    sets = {i: grams(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in edges:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()} == comp


@pytest.mark.parametrize("pairs", [4, 1000])
def test_what_stars_leave_open_is_found(spark, monkeypatch, pairs):
    monkeypatch.setattr(near_dup, "PAIRS", pairs)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    rnd = random.Random(7)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for i in range(40):  # loosely similar, one large bucket; every fourth has a near copy
        words = shared + [f"w{rnd.randrange(10**6)}" for _ in range(60)]
        texts.append(words)
        if i % 4 == 0:
            texts.append([*words[:110], *(f"v{rnd.randrange(10**6)}" for _ in range(8)), *words[112:]])
    grams = [set(zip(w, w[1:], strict=False)) for w in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    held = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "rep bigint, text string")
    posts = spark.createDataFrame([(1, i, len(grams[i]), i) for i in range(len(texts))], "bucket bigint, rep bigint, n bigint, comp bigint")
    got = {(max(r), min(r)) for r in near_dup._rest(posts, held, 2).collect()}
    assert len(want) == 10 and got == want


def test_every_distinct_text_of_an_id_stays(spark):
    w = lambda p: " ".join(f"{p}{i}" for i in range(40))
    df = spark.createDataFrame([(1, w("a")), (1, w("b")), (1, w("a")), (2, w("b")), (3, None), (3, None), (3, ""), (None, w("a"))], "doc_id bigint, text string").withColumn("th", F.lit("x"))
    got = sorted(((r.doc_id or 0, r.text or "") for r in near_dup.deduplicated(df).collect()))
    assert got == [(0, w("a")), (1, w("a")), (1, w("b")), (3, ""), (3, "")]
    near = near_dup.near_duplicates(df).collect()
    assert len(near) == 8 and {r.component_id for r in near if r.doc_id == 2} == {1}


def test_mix_is_what_mix_says(spark):
    rows = [(None, "a b c", "x"), (1, "d e", "x"), (1, "f g h", "y"), (2, "", "y"), (2, None, None), (3, "i", None), (4, "j k l m", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = sorted((r.doc_id or 0, r.size, r.copies) for r in mixing.mix(df.withColumn("copies", F.lit(9))).select("doc_id", "size", "copies").collect() if r.copies)
    got = {}
    for r in mixing.mixed(df).collect():
        key = (r.doc_id or 0, len((r.text or "").split()))
        got[key] = got.get(key, 0) + 1
    assert sorted((*k, n) for k, n in got.items()) == taken
    docs = table(spark, DIR, "documents")
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    assert mixing.mixed(docs).agg(F.sum(words)).first()[0] == mixing.mix(docs).agg(F.sum("taken")).first()[0]


def test_languages_without_labels_and_too_many(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, None), (3, "12", None)], "doc_id bigint, text string, lang string")
    assert language_id.fit(df) is None and [r.doc_id for r in language_id.accepted(df, None).collect()] == [1]
    many = spark.range(900).selectExpr("id AS doc_id", "'text' AS text", "concat('l', id) AS lang")
    with pytest.raises(ValueError):
        language_id.fit(many)
    docs = table(spark, DIR, "documents")
    odd = docs.limit(5).withColumn("text", F.lit(None).cast("string")).unionByName(docs.limit(5)).withColumn("row", F.lit(1))
    got = language_id.accepted(odd, language_id.fit(docs))
    assert got.count() == 5 and got.columns == odd.columns


def test_language_is_learned_from_the_rest(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identify(docs, language_id.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() > 0.98 * got.count()


def test_letters_of_no_learned_language_go(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    net = language_id.fit(docs)
    rnd = random.Random(4)
    rows = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(400)) for _ in range(20)]
    rows += [base64.b64encode(rnd.randbytes(300)).decode() for _ in range(20)] + [rnd.randbytes(200).hex() for _ in range(20)]
    rows += ["q" * 300, "все люди рождаются свободными и равными в своем достоинстве и правах", "όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια", "人人生而自由在尊严和权利上一律平等他们赋有理性和良心"]
    odd = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    assert language_id.accepted(odd, net).count() == 0
    assert language_id.identify(odd, net).where("lang_pred = 'und'").count() == 0  # a text with a letter gets the best learned language
    assert language_id.accepted(docs, net).count() == docs.count()


def test_gradients_by_differences():
    import numpy as np

    net = language_id.GatedNetwork(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y, mask = rng.integers(0, 256, (6, 4)).astype(np.uint8), np.array([0, 1, 1, 0]), np.ones((6, 4))
    mask[4:, 1] = 0

    def loss():
        z = np.concatenate([net.states(x, mask, d) for d in "fb"], -1) @ net.w["V"] + net.w["c"]
        z = z - np.log(np.exp(z).sum(-1, keepdims=True))
        return -(z[:, np.arange(4), y] * mask).sum() / mask.sum()

    g = net.gradients(x, mask, y)
    for k in ("Uf", "Ub", "V", "c"):
        at = tuple(np.array(net.w[k].shape) // 2)
        old = net.w[k][at]
        net.w[k][at] = old + 1e-2
        up = loss()
        net.w[k][at] = old - 1e-2
        down = loss()
        net.w[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=1e-4)


def test_main_text(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    got = {r.page_id: r.text for r in html_main_text.extract(pages, html_main_text.fit(pages)).collect()}
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


def test_main_text_without_prior_words(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    w = html_main_text.fit(pages, prior={})
    assert {"nav", "footer", "div.ad"} <= set(w.context)
    right = 0
    for r in pages.collect():
        article = re.search("(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)\b[^>]*>", article))
        right += html_main_text.main_text(r.html, w) == "\n".join(b for b in blocks if b)
    assert right >= 240


def test_best_region_against_brute_force():
    rnd = random.Random(6)
    for _ in range(300):
        s = [rnd.choice((-3, -2, -1, 0, 1, 2)) for _ in range(rnd.randrange(0, 14))]
        sums = {(i, j): sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        top = max(sums.values(), default=0)
        first, end = html_main_text.best_region(s)
        assert sum(s[first:end]) == max(top, 0) and (top <= 0) == (first == end)


def test_main_text_is_linear_and_keeps_rows(spark):
    import time

    w = html_main_text.Weights.learned(["<nav>m n</nav><article><p>one two three</p></article>"] * 3)
    for part in ("<a ", '<a "', '<a x="', "<div class=ad>", "<!--", "<script>", "</p ", "<div class=ad></div>"):
        begun = time.process_time()
        html_main_text.main_text(part * 100_000, w)
        assert time.process_time() - begun < 4, part
    assert html_main_text.main_text("a b c<script>var x = 1;", w) == "a b c" and html_main_text.main_text("a b<style>p{}</style> c", w) == "a b c"
    assert html_main_text.main_text("<header>site</header><article><header>Title</header><p>t u v</p></article><header>no</header>", w) == "Title\nt u v"
    body = "<p>some words of the text that go on</p>" * 8
    for wrapper in ("layout has-sidebar", "comments-open post", "search-result-page", "search"):
        assert html_main_text.main_text(f"<nav>m</nav><div class='{wrapper}'><article>{body}</article></div>", w).count("some") == 8
    assert html_main_text.main_text(f"<nav class='x main'>m</nav><form id=page><div>{body}</div></form>", w).count("some") == 8
    rows = spark.createDataFrame([(1, "u", "<p>x y</p>"), (1, "u", "<p>x y</p>"), (2, None, None), (None, "v", "")], "page_id bigint, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit(2)})
    assert sorted((r.page_id or 0, r.text) for r in html_main_text.extract(rows, w).collect()) == [(0, ""), (1, "x y"), (1, "x y"), (2, "")]


def test_main_text_cases():
    w = html_main_text.Weights.learned(["<nav><a href=x>m n</a></nav><article><p>one two three</p></article><footer>f</footer>"] * 3)
    page = "<div class='menu'>a b</div><article><h1>T&eacute;</h1><p>x <i>y</i>\n z<p>q r</p><section id=comments>no</section><aside>no</aside></article><form>no</form>"
    assert html_main_text.main_text(page, w) == "Té\nx y z\nq r"
    assert [html_main_text.main_text(p, w) for p in (None, "", "<p>", "<<<", "plain words")] == ["", "", "", "<<<", "plain words"]


def test_licenses_against_brute_force():
    index = license_scan.Index(license_scan.NOTICES)
    rnd = random.Random(3)
    for name, notice in license_scan.NOTICES.items():
        words = notice.split()
        pad = " ".join(f"w{rnd.randrange(99)}" for _ in range(300))
        assert index.scan(f"{pad} {notice} {pad}")[name] == 1.0
        if len(words) > 30:
            spoiled = words[:2] + ["x"] + words[3:]
            assert 0.8 <= index.scan(f"{pad} {' '.join(spoiled)} {pad}")[name] < 1
            assert name not in index.scan(f"{pad} {' '.join(words[: len(words) // 2])} {pad}")
    assert index.scan(None) == index.scan("") == {}


def test_licenses_by_notices_from_elsewhere():
    index = license_scan.Index(license_scan.NOTICES)
    cases = {
        "Copyright 2020 A. Author. All rights reserved.": "reserved-short",
        "This project is licensed under the MIT License - see the LICENSE file": "MIT",
        "Distributed under the BSD 3-Clause License": "BSD-3-Clause",
        "This program is free software under the GNU General Public License version 2": "GPL-2.0",
        "This library is licensed under the GNU Lesser General Public License, version 2.1": "LGPL-2.1",
        "Licensed under the AGPLv3 or later": "AGPL-3.0",
        "subject to the terms of the Mozilla Public License, v. 2.0. If a copy": "MPL-2.0",
        "To the extent possible, waived under CC0 by its author": "CC0-1.0",
        "licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License": "CC-BY-SA-3.0",
        "Licensed under the ISC License": "ISC",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        "# SPDX-License-Identifier: EPL-2.0": "EPL-2.0",
    }
    words = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    for text, license_ in cases.items():
        padded = " ".join(f"w{i}" for i in range(40)) + f" {text} " + " ".join(f"v{i}" for i in range(40))
        own = words(padded)
        want = set()
        for name, notice in license_scan.NOTICES.items():
            t = words(notice)
            k = min(5, len(t))
            grams = {tuple(t[i : i + k]) for i in range(len(t) - k + 1)}
            if len(grams & {tuple(own[i : i + k]) for i in range(len(own) - k + 1)}) >= 0.8 * len(grams):
                want.add(name)
        got = set(index.scan(padded))
        assert got == want and any(n.startswith(license_) for n in got), (text, got, want)
    assert not any(n.startswith("GPL-3") for n in index.scan("This work is licensed under the GNU General Public License, version 2."))
    assert index.scan("the author reserved all seats by right of the house, under the mit of the glove") == {}


def test_license_texts_are_retrieved_wherever_some_window_holds_them():
    texts = {k: v for k, v in license_scan.NOTICES.items() if k.endswith("-text")}
    index, rnd, expected, found = license_scan.Index(texts), random.Random(8), 0, 0
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    words = lambda t: re.findall(r"[0-9a-z]+", t.lower())
    for name, text in texts.items():
        own = set(grams(words(text)))
        for spoilt in range(0, 10):
            w = words(text)
            for _ in range(spoilt * len(w) // 200):
                at = rnd.randrange(len(w))
                w[at : at + 1] = rnd.choice(([], ["x"], ["x", "y"]))
            pad = lambda: [f"n{rnd.randrange(50)}" for _ in range(rnd.randrange(5, 200))]
            doc = pad() + w + pad()
            g, span = grams(doc), 1 << (len(own) - 1).bit_length()
            best = max(len(own & set(g[b : b + 2 * span])) for b in range(0, max(1, len(g) - span), 3)) / len(own)
            if best >= 0.8:
                expected += 1
                found += name in index.scan(" ".join(doc))
    assert expected > 40 and found >= 0.98 * expected


def test_url_rules(spark):
    rules = url_filters.rule_table(spark, [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "a.org/pre")])
    rows = [(1, None), (2, "no scheme"), (3, "http://WWW.example.com/en/1?x"), (4, "http://m.example.com/en/1#f"), (5, "http://example.com"), (6, "http://a.org/prefix"), (7, "http://notexample.com/en/"), (7, "http://notexample.com/en/"), (8, "http://x.com?/en/")]
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect())
    assert [g[0] for g in got] == [r[0] for r in rows]
    by = {g[0]: g[1:] for g in got}
    assert by[1] == by[2] == ("", "", None, "allow") and by[3] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and by[4][2:] == ("example.com/en/", "block")
    assert by[5] == ("example.com", "", None, "allow") and by[6][2:] == ("a.org/pre", "block") and by[7][2:] == ("com/", "allow") and by[8][1:] == ("", None, "allow")


def test_store_versions(spark, tmp_path):
    docs = table(spark, DIR, "documents")
    store = sharding.ShardStore(spark, str(tmp_path), docs.schema, target=200_000, arrival=20_000)
    assert store.append(docs.where("doc_id < 100").repartition(8)) == 1
    assert store.append(docs.where("doc_id >= 100").repartition(8)) == 2
    assert store.compact() == 3
    rows = lambda v: sorted(r.doc_id for r in store.read(v).select("row.doc_id").collect())
    assert rows(1) == list(range(100)) and rows(2) == rows(3) == sorted(r.doc_id for r in docs.collect())
    assert store.manifest(3).count() < store.manifest(2).count()
    with pytest.raises(RuntimeError):
        store._commit(store.manifest(), 2)
    store.vacuum()
    assert rows(3) == rows(None)


def test_of_two_writers_one_wins(spark, tmp_path):
    from threading import Barrier, Thread

    docs = table(spark, DIR, "documents").limit(20)
    store = sharding.ShardStore(spark, str(tmp_path), docs.schema)
    store.append(docs)
    for base in (1, 2, 3):
        manifest, wall, said = store.manifest(base), Barrier(2), []

        def commit(manifest=manifest, wall=wall, said=said, base=base):
            wall.wait()
            try:
                said.append(store._commit(manifest, base))
            except RuntimeError as e:
                said.append(str(e))

        writers = [Thread(target=commit) for _ in range(2)]
        for t in writers:
            t.start()
        for t in writers:
            t.join()
        assert said.count(base + 1) == 1 and sum("another writer" in str(x) for x in said) == 1
        assert store.version() == base + 1 and store.read().count() == 20
    assert sorted(f.name for f in (tmp_path / "versions").iterdir() if not f.name.endswith(".crc")) == [f"{v:08d}" for v in range(1, 5)]


def test_shards_are_bounded_and_whole(spark, tmp_path):
    rows = [(i, "x" * (50 if i % 50 else 30_000)) for i in range(2000)] + [(None, None), (7, "x" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"shard": F.lit("a"), "bytes": F.lit(1)})
    for parts in (1, 16):
        store, version = sharding.shard(df.repartition(parts), str(tmp_path / str(parts)), arrivals=2, target=100_000, arrival=10_000)
        got = store.read(version)
        assert sorted((str(r.doc_id), len(r.text or "")) for r in got.select("row.*").collect()) == sorted((str(i), len(t or "")) for i, t in rows)
        sums = got.groupBy("shard").agg(F.sum("_bytes").alias("b"), F.count("*").alias("n"), F.first("bytes").alias("mb"), F.first("rows").alias("mr")).collect()
        assert all(r.b == r.mb and r.n == r.mr and r.b < 2 * 100_000 for r in sums)
        live = {f for f in (tmp_path / str(parts) / "data").rglob("*.parquet")}
        assert len(live) <= len(sums) + 4  # superseded shards are gone


def test_url_rules_take_any_columns(spark):
    rules = url_filters.rule_table(spark, [("block", "a.org/x/")])
    df = spark.createDataFrame([(1, "http://a.org/x/1"), (1, "http://a.org/x/1"), (None, "http://b.a.org/x/y/z"), (2, "http://a.org/xy")], "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "rule", "verdict", "prefix", "expr")})
    got = url_filters.judge(df, rules).collect()
    assert sorted((r.page_id or 0, r.verdict) for r in got) == [(0, "block"), (1, "block"), (1, "block"), (2, "allow")]


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = table(spark, DIR, "documents")
    cols = docs.columns
    foreign = docs.limit(3).withColumns({"doc_id": F.col("doc_id") + 10**6, "text": F.lit("qxz vkj wqp zzx jkq " * 20), "lang": F.lit(None).cast("string")})
    docs = docs.unionByName(foreign).unionByName(docs.where("doc_id < 5"))
    why = {"language_id": lambda b, d: b.count() - d.count() >= 3 and d.where("doc_id >= 1000000").count() == 0, "near_dedup": lambda b, d: d.count() == d.select("doc_id").distinct().count() < b.count(), "decontamination": lambda b, d: d.count() < b.count()}
    why["mixing"] = lambda b, d: d.count() == mixing.mix(b).agg(F.sum("copies")).first()[0]
    why["sharding"] = lambda b, d: d.count() == b.count() and d.columns == [*cols, "shard"]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, durable(stage(spark, docs, DIR))
        assert docs.columns == cols or name == "sharding"
        assert why[name](before, docs), name
    ids = {r.doc_id for r in docs.collect()}
    leaks = decontaminate.contaminated(table(spark, DIR, "documents"), table(spark, DIR, "benchmark"))
    assert not ids & {r.doc_id for r in leaks.collect()}


def test_pipeline_stages_on_odd_rows(spark, nasty):
    import corpus_pipeline

    for docs in (nasty, nasty.where("false")):
        cols = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs.count(), durable(stage(spark, docs, DIR))
            assert docs.columns == (cols if name != "sharding" else [*cols, "_shard"])
            assert (docs.count() == 0) == (before == 0)
    assert corpus_pipeline.run(spark, DIR).count() > 0
