"""Spelling variants, whitening and personal data against brute force, and their defined cases."""

import hashlib
import random
import os
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from crawlspark.llm import html_main_text, language_id, personal_data, sharding, spelling, whitening
from crawlspark.llm.common import table

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string"


def odd(df):
    """With extra columns named like helpers."""
    return df.withColumns({c: F.lit(1) for c in ("word", "n", "id", "k", "row", "v", "w", "key", "base", "found", "instance")})


# --- spelling variants


def brute_counts(rows):
    found = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if doc is None else doc}:{low}".encode())
            if h % 97 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            found[low] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_spelling_equals_brute_force_on_dense_words(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["".join(rnd.choice("abÀ") for _ in range(rnd.choice([5, 5, 6, 6, 7, 8]))) for _ in range(260)] + ["aaaaa", "aaaaaa", "aaaaaaa", "baaaa", "abaaaa"]
    rows = [(i if i % 7 else None, " ".join(rnd.choice(vocabulary[: 10 + i]).replace("a", rnd.choice("aA")) for _ in range(60))) for i in range(200)]
    want = brute_variants(brute_counts(rows))
    assert len(want) > 100 and any(w != r and f != r for w, f, r, *_ in want if f)  # chains of two and more
    for hot in (20_000, 5):  # with every edge in the bounded table, and with few
        monkeypatch.setattr(spelling, "HOT", hot)
        got = spelling.spelling_variants(odd(spark.createDataFrame(rows, DOCS))).collect()
        assert len(got) == len(want) and rows_of(spark.createDataFrame(got)) == want


def test_every_pair_is_found_once(spark):
    rnd = random.Random(9)
    words = sorted({"".join(rnd.choice("ab") for _ in range(rnd.randint(1, 7))) for _ in range(300)})
    got = [(r.word, r.near) for r in spelling.near_words(spark.createDataFrame([(w, 3) for w in words], "word string, n bigint")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_chains_of_forms_are_followed_to_the_end(spark):
    chain = [f"w{i:02}" for i in range(20)]
    got = spelling.roots(spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string"))
    assert {(r.word, r.root) for r in got.collect()} == {(w, "w19") for w in chain[:-1]}


def test_spelling_defined_cases(spark):
    assert spelling.spelling_variants(odd(spark.createDataFrame([], DOCS))).count() == 0
    assert spelling.spelling_variants(odd(spark.createDataFrame([(1, None), (2, ""), (3, "  12 ab")], DOCS))).count() == 0
    long = "x" * 50_000
    rows = [(5, f"{long} {long}y {long} {long}y"), (5, f"{long} {long}y {long} {long}y"), (None, "hello hello"), (None, "hello Hello hellO hallo hallo hallo")]
    assert rows_of(spelling.spelling_variants(odd(spark.createDataFrame(rows, DOCS)))) == brute_variants(brute_counts(rows))


# --- whitening


def test_sums_lose_nothing():
    rnd = random.Random(1)
    xs = np.array([rnd.uniform(-1, 1) * 10.0 ** rnd.randint(-12, 12) for _ in range(501)])
    high, low = whitening.fold(xs[:, None], np.zeros((501, 1)))
    exact = sum(map(Fraction, xs.tolist()))
    assert abs(Fraction(high[0]) + Fraction(low[0]) - exact) <= abs(exact) * Fraction(1, 2**95)
    p, e = whitening.two_product(xs[:-1], xs[1:])
    assert all(Fraction(a) + Fraction(b) == Fraction(x) * Fraction(y) for a, b, x, y in zip(p, e, xs[:-1], xs[1:], strict=True))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["full", "same", "pairs", "low rank", "zero"])
def test_divide_and_conquer(n, kind):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n if kind == "full" else max(1, n // 3)))
    a = {"full": b @ b.T, "low rank": b @ b.T, "same": np.eye(n) * 3, "pairs": np.diag(np.arange(n) // 2).astype(float), "zero": np.zeros((n, n))}[kind]
    e, u = whitening.eigen(a)
    assert np.allclose(e, np.maximum(np.linalg.eigvalsh(a)[::-1], 0), atol=1e-13 * max(1, abs(a).max()) * n)
    assert abs(u.T @ u - np.eye(n)).max() < 1e-14 * max(4, n) and abs(a @ u - u * e).max() <= 1e-14 * max(4, n) * max(1, abs(a).max())


def check_whitened(rows, got, k):
    """Against exact rational sums."""
    n, d = len(rows), len(rows[0][1])
    x = [[int(np.floor(64.0 * float(c))) + 1_000_000 for c in v] for _, v in rows]
    s = [sum(c) for c in zip(*x, strict=True)]
    deviation = Counter((r[0], sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True))) for r, v in zip(rows, x, strict=True))
    assert Counter((r.vec_id, r.deviation) for r in got if r.component == 1) == deviation
    assert {r.n for r in got} == {n} and len(got) == n * k
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(v, s, strict=True)] for v in x])
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3)) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    for c in range(k):
        mine = sorted((r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1)
        assert [r.explained for r in got if r.component == c + 1] == pytest.approx([e[c] / np.trace(v)] * n, rel=1e-9)
        want = [(r[0], t, w) for r, t, w in zip(rows, [sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)) for v in x], centred @ u[:, c] / np.sqrt(e[c]), strict=True)]
        sign = np.sign(sum(a[2] * b[2] for a, b in zip(mine, sorted(want), strict=True)))
        assert all(abs(a[2] - sign * b[2]) < 1e-6 for a, b in zip(mine, sorted(want), strict=True))


def test_whitening_equals_exact_sums(spark):
    rng = np.random.default_rng(3)
    rows = [(i % 60, [float(c) for c in np.float32(rng.normal(size=8) * np.arange(1, 9) + 100)]) for i in range(70)]
    got = whitening.whiten(odd(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).repartition(5), components=5).collect()
    check_whitened(rows, got, 5)
    assert {r.identity_error for r in got}.pop() < 1e-9


def test_whitening_of_the_table(spark):
    got = whitening.whiten(table(spark, DIR, "embeddings")).toPandas()
    wide = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert wide.shape == (len(wide), 32) and abs(np.cov(wide.T, bias=True) - np.eye(32)).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9 and (got.groupby("component").explained.first().diff()[1:] <= 0).all()


def test_whitening_defined_cases(spark):
    schema, nan = "vec_id bigint, embedding array<float>", float("nan")
    make = lambda rows: whitening.whiten(odd(spark.createDataFrame(rows, schema)), components=2).collect()
    assert make([]) == [] and make([(1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [float("inf"), 0.0])]) == [] and make([(1, [])]) == []
    one = make([(1, [1.0, 2.0])])
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, None, None, None), (2, 0, None, None, None)]
    got = make([(1, [1.0, 2.0]), (None, [3.0, 2.0]), (1, [1.0, 2.0]), (7, [1.0]), (8, [1.0, nan])])
    assert len(got) == 6 and {r.n for r in got} == {3} and all((r.whitened is None) == (r.component == 2) for r in got)
    assert sorted(round(r.whitened, 9) for r in got if r.component == 1) in ([round(-(2**0.5), 9), *[round(0.5**0.5, 9)] * 2], [*[round(-(0.5**0.5), 9)] * 2, round(2**0.5, 9)])
    large = make([(1, [70000.0, 0.0]), (2, [0.0, 0.0])])
    assert {r.deviation for r in large} == {(70000 * 64) ** 2}
    with pytest.raises(Exception, match="is no long"):
        make([(1, [1e30, 0.0]), (2, [0.0, 0.0])])


# --- personal data


def brute_base(text):
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for k, expression, sizes in ((2, r"[0-9]([\x20-]?[0-9])+", range(13, 20)), (3, r"\+[0-9][\x20().0-9-]+[0-9]", range(9, 16))):
        for m in re.finditer(expression, text):
            digits = [int(c) for c in m[0] if c.isdigit()]
            check = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
            if len(digits) in sizes and (k == 3 or check):
                found.append((k, *m.span()))
    return found


def test_seeds_equal_the_plain_expressions():
    rnd = random.Random(8)
    pieces = ["a@b.c", "@", ".", "+", "1", "255", "256", "0000012", " ", "-", "x", "é", "4111 1111-1111 1111", "5500005555555559", "+1 (555) 555-0199", "10.0.0.1", "(", ")", "a.b%c", "\n", "+49 30 1234567", "12345678901234567890"]
    for _ in range(4000):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 14)))
        assert personal_data.base_spans(text) == brute_base(text), text


def test_seeds_are_linear():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + " " * 400_000, "a@" * 200_000, "1 " * 200_000, "=" * 400_000 + "1"):
        spans = personal_data.base_spans(text)
        assert len(list(personal_data.mentions(text, spans))) <= 1


def brute_added(texts, trust=personal_data.TRUST, accept=personal_data.ACCEPT, support=personal_data.SUPPORT, rounds=personal_data.ROUNDS):
    """(text number, kind, start, end) of the added spans, scored with plain dictionaries."""
    seen, edges = [], defaultdict(set)
    score = {}
    for t, text in enumerate(texts):
        seeds = brute_base(text)
        for k, s, e in [*seeds, *((None, s, e) for s, e in personal_data.mentions(text, seeds))]:
            found = personal_data.patterns(text, s, e)
            seen.append((t, k, s, e, text[s:e].lower(), found))
            for p in found:
                edges[p].add(text[s:e].lower())
            if k is not None and found:
                score[text[s:e].lower()] = min(score.get(text[s:e].lower(), (9, 1)), (k, 1))
    seeds, n = dict(score), -1
    for _ in range(rounds):
        trusted = {}
        for p, xs in edges.items():
            best = max((sum(score[x][1] for x in xs if x in score and score[x][0] == k) / (len(xs) + 1), -k, sum(x in score and score[x][0] == k for x in xs)) for k in range(4))
            if best[0] >= trust - 1e-12 and best[2] >= support:
                trusted[p] = (-best[1], best[0])
        score, left, kinds = dict(seeds), defaultdict(lambda: 1.0), {}
        for p, (k, s) in trusted.items():
            for x in edges[p] - seeds.keys():
                left[x] *= 1 - s
                kinds[x] = max(kinds.get(x, (-1, 0)), (s, -k))
        score |= {x: (-kinds[x][1], 1 - q) for x, q in left.items() if 1 - q >= accept}
        if len(score) == n:
            break
        n = len(score)
    out = set()
    for t, k, s, e, x, found in seen:
        kinds = [(trusted[p][1], -trusted[p][0]) for p in found if p in trusted]
        if k is None and kinds and x in score:
            out.add((t, -max(kinds)[1], s, e))
    return out


def contacts():
    """Seeds after telling words; unseen identifiers after the same words, and numbers elsewhere."""
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(4, 9)))
    number = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    texts = [f"{word()} please write to {word()}@{word()}.org {word()}" for _ in range(30)] + [f"{word()} Call us at +1 {number(3)} {number(7)} {word()}" for _ in range(30)]
    texts += [f"{word()} please write to {word()}[at]{word()}{number(3)} {word()}" for _ in range(3)] + [f"{word()} call us at ({number(3)}) 555-{number(4)}, {word()}" for _ in range(3)]
    texts += [f"{word()} {word()} {number(8)} {word()} version {number(5)}" for _ in range(40)]
    return texts


def test_contexts_discover_unseen_identifiers(spark):
    texts = contacts()
    got = {r.doc_id: r for r in personal_data.personal_data(odd(spark.createDataFrame(list(enumerate(texts)), DOCS)).repartition(3)).collect()}
    assert all(got[i].n_added == (60 <= i < 66) for i in got)
    for i in range(60, 66):
        kind, start, end = got[i].spans.split(":")
        assert kind == ("email" if i < 63 else "phone") and re.fullmatch(r"\w+\[at\]\w+" if i < 63 else r"\(\d{3}\) 555-\d{4}", texts[i][int(start) : int(end)])


def test_scores_equal_brute_force(spark):
    rnd = random.Random(6)
    places = ["id no", "mail to", "reach me", "at the", "card is", "seen on"]
    values = [f"u{i}@m{i}.com" for i in range(12)] + [f"+1 555 00{i:05}" for i in range(12)] + [f"A-{i:06}" for i in range(12)]
    for seed in range(3):
        rnd.seed(seed)
        texts = [f"x {(p := rnd.randrange(6)) and places[p] or places[0]} {values[min(35, int(rnd.triangular(0, 36, 6 * p)))]} {rnd.choice('yz')}" for _ in range(150)]
        settings = {"trust": 0.45, "accept": 0.5, "support": 3}
        got = personal_data.personal_data(spark.createDataFrame(list(enumerate(texts)), DOCS), **settings).collect()
        added = {(r.doc_id, *x) for r in got for x in ((personal_data.KINDS.index(k), int(s), int(e)) for k, s, e in (y.split(":") for y in r.spans.split(",") if y)) if x not in brute_base(texts[r.doc_id])}
        want = brute_added(texts, **settings)
        assert added == want and sum(r.n_added for r in got) == len(want)
    assert want


def test_personal_data_of_the_table(spark):
    docs = table(spark, DIR, "documents")
    got = {r.doc_id: r for r in personal_data.personal_data(docs).collect()}
    for r in docs.select("doc_id", "text").collect():
        base = brute_base(r.text or "")
        line = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in base)
        g = got[r.doc_id]
        assert g.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(sum(k == i for k, *_ in base) for i in range(4))
        assert set(line.split(",")) <= set(g.spans.split(","))


def test_personal_data_defined_cases(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert personal_data.personal_data(odd(spark.createDataFrame([], DOCS))).count() == 0
    rows = [(1, None), (1, ""), (None, "a@b.co"), (None, "a@b.co"), (2, " \t"), (3, "é" * 100_000 + " x@y.zz")]
    got = personal_data.personal_data(odd(spark.createDataFrame(rows, DOCS))).collect()
    assert Counter((r.doc_id, r.spans) for r in got) == Counter({(1, ""): 2, (None, "email:0:6"): 2, (2, ""): 1, (3, "email:100001:100007"): 1}) and sum(r.base_sha256 == empty for r in got) == 3


# --- language answers and the shard store


def test_texts_with_a_letter_get_a_learned_language(spark):
    docs = table(spark, DIR, "documents")
    net = language_id.fit(docs)
    rows = ["все люди рождаются свободными", "όλοι οι άνθρωποι", "xq zvw kkp", "Call 555 2234, 99 Oak St, AB 1234", "a", None, "", "12 34", "\n"]
    got = [r.lang_pred for r in language_id.identify(spark.createDataFrame([(i, t, None) for i, t in enumerate(rows)], "doc_id bigint, text string, lang string"), net).orderBy("doc_id").collect()]
    learned = {r.lang for r in docs.select("lang").distinct().collect()}
    assert set(got[:5]) <= learned - {None, "und"} and got[5:] == ["und"] * 4


def test_vacuum_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    docs = table(spark, DIR, "documents")
    store = sharding.ShardStore(spark, str(tmp_path), docs.schema, target=200_000, arrival=20_000)
    store.append(docs.where("doc_id < 50"))
    commit, other = store._commit, sharding.ShardStore(spark, str(tmp_path), docs.schema)

    def late(manifest, base):
        other.vacuum()  # after the data are written, before they are committed
        return commit(manifest, base)

    store._commit = late
    store.append(docs.where("doc_id >= 50").repartition(8))
    store.compact()
    assert sorted(r.doc_id for r in other.read().select("row.doc_id").collect()) == sorted(r.doc_id for r in docs.collect())
    assert not os.listdir(tmp_path / "writing") or all(f.endswith(".crc") for f in os.listdir(tmp_path / "writing"))
    store._commit = lambda manifest, base: (_ for _ in ()).throw(RuntimeError("died"))
    with pytest.raises(RuntimeError):
        store.append(docs)
    runs = len(os.listdir(tmp_path / "data"))
    (tmp_path / "writing" / max(os.listdir(tmp_path / "data"), key=lambda f: os.path.getmtime(tmp_path / "data" / f)).removeprefix("run=")).touch()
    other.vacuum()
    monkeypatch.setattr(sharding, "ABANDONED", -10)
    assert len(os.listdir(tmp_path / "data")) >= 2
    other.vacuum()
    assert len(os.listdir(tmp_path / "data")) < runs and other.read().count() == docs.count()


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    docs = table(spark, DIR, "documents").limit(20)
    store = sharding.ShardStore(spark, str(tmp_path), docs.schema)
    store.append(docs)
    (tmp_path / "versions" / ".abc").touch()  # a writer that died before it published
    assert store.version() == 1 and store.read().count() == 20
    store.append(docs)
    assert store.version() == 2 and store.read().count() == 40


# --- main text by scans


def brute_stretches(scores):
    """By the definition: the least contiguous sum (the shortest, then first of equals), then both sides."""
    best = min(((sum(scores[a:b]), b - a, a) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] >= 0:
        return []
    a, b = best[2], best[2] + best[1]
    return brute_stretches(scores[:a]) + [(a, b)] + [(x + b, y + b) for x, y in brute_stretches(scores[b:])]


def test_stretches_equal_their_definition():
    rnd = random.Random(3)
    for _ in range(400):
        scores = [rnd.uniform(-3, 3) for _ in range(rnd.randint(0, 14))]
        assert html_main_text.stretches(scores) == brute_stretches(scores)
    assert len(html_main_text.stretches([-1.0, 2.0] * 100_000)) == 100_000


@pytest.fixture(scope="module")
def weights(spark):
    return html_main_text.fit(table(spark, "/root/testdata/sf0.01", "pages"))


SENTENCE = "The quick brown fox jumps over the lazy dog near the river bank today."
BODY = "".join(f"<p>{SENTENCE} {i}</p>" for i in range(4))
TEXT = "\n".join(f"{SENTENCE} {i}" for i in range(4))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='story'>{}</div>", "{}", "<main>{}</main>"])
@pytest.mark.parametrize("learned", [True, False])
@pytest.mark.parametrize("n", [1, 4, 5, 30, 300])
def test_comments_and_menus_longer_than_the_article_stay_out(weights, wrap, learned, n):
    w = weights if learned else html_main_text.Weights.learned([])
    comments = "".join(f"<div class='comment'><b>Reader {i}</b><p>I do not agree with this at all, said the man from far away.</p></div>" for i in range(n))
    menu = "<div class='menu'>" + "word and word again " * 2 * n + "</div>"
    for page in (wrap.format(BODY) + f"<div class='comments'>{comments}</div>", menu + wrap.format(BODY), f"<body>{menu}{wrap.format(BODY)}<section id='comments'>{comments}</section><footer>{'legal words ' * n}</footer></body>"):
        assert html_main_text.main_text(page, w) == TEXT


def test_wrappers_by_structure_and_unknown_side_blocks(weights):
    main_text = html_main_text.main_text
    assert main_text(f"<form id='f'><div class='ad page'><h1>Head</h1>{BODY}</div><nav>a b</nav></form>", weights) == f"Head\n{TEXT}"  # holds the heading and paragraphs
    assert main_text(f"<body class='comments'>{BODY}</body>", weights) == TEXT  # holds every word
    box = "<div class='taboola-box'>" + "<a href='x'>You will not believe it</a> " * 9 + "</div>"
    bottom = f"<div class='page-bottom'>{SENTENCE * 9}</div>"
    assert main_text(f"{box}<article>{BODY}</article>{bottom}", weights) == TEXT
    links = "<ul class='zz'>" + "<li><a href='x'>Old story</a></li>" * 9 + "</ul>"
    assert main_text(f"{links}<div>{BODY}</div>{links}", weights) == TEXT  # the scan, as nothing is known of zz
    assert main_text(f"<article><p>{SENTENCE} 0</p><div class='ad'>Buy {SENTENCE * 20}</div>" + "".join(f"<p>{SENTENCE} {i}</p>" for i in (1, 2, 3)) + "</article>", weights) == TEXT
    assert main_text("<nav>a b c</nav><footer>d</footer>", weights) == "" and main_text("<div class='comments'><p>one two</p></div><nav>x</nav>", weights) == ""


def test_the_scan_decides(spark, weights, monkeypatch):
    """With the whole page in place of the best region, link lists outside come out on pages without article."""
    html = [re.sub(r"(?i)<(/?)(article|nav|footer)\b[^>]*>", r"<\1div>", r.html) for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    by_scan = [html_main_text.main_text(h, weights) for h in html]
    monkeypatch.setattr(html_main_text, "best_region", lambda scores: (0, len(scores)))
    assert sum(a != html_main_text.main_text(h, weights) for a, h in zip(by_scan, html, strict=True)) > 0.9 * len(html)
