import re

import numpy as np
from pyspark.sql import functions as F

from huescope.llm import decontaminate, langid, pii, quality, urlfilter
from huescope.llm.common import in_fold, outside_fold
from huescope.llm.queries import URL_RULES

from .data import ODD_TEXTS, as_rows, documents

PASSAGE = "A train leaves the old station at noon and needs 3 hours to cover 240 km before Maria meets it at the second bridge near the river"


def bench(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def filler(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def test_decontamination_finds_copies_and_new_parameters(spark):
    texts = [
        filler(200, 1),
        filler(90, 2) + " " + PASSAGE + ". " + filler(90, 3),
        filler(50, 4) + ". " + PASSAGE.replace(" 3 ", " 5 ").replace("240", "400").replace("Maria", "Peter"),
        PASSAGE.lower().replace(" at noon", ",\n\nat  noon"),
        None, "", "a b c", "short item of five words here",
        " ".join(PASSAGE.split()[:9]) + " " + filler(60, 5),
    ]
    docs = documents(spark, texts)
    found = decontaminate.find_contaminated(docs, bench(spark, PASSAGE, None, "", "too short", "short item of five words here"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0), (7, 4)}
    assert not got[1, 0].reparameterised and got[2, 0].reparameterised
    left = decontaminate.remove_contaminated(docs, bench(spark, PASSAGE))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {0, 4, 5, 6, 7, 8}
    assert as_rows(decontaminate.find_contaminated(documents(spark, []), bench(spark, PASSAGE))) == []
    assert as_rows(decontaminate.find_contaminated(docs, bench(spark))) == []


def test_decontamination_needs_slots_that_agree(spark):
    item = "add 4 to 9 then take 4 from 9 and write 4 beside 9 so that 4 times 9 comes to 4 twice"
    fits, other, n = item.replace("4", "6").replace("9", "2"), item, 0
    for v in re.findall(r"\b[49]\b", item):
        n += 1
        other = re.sub(rf"\b{v}\b", str(100 + n), other, count=1)
    found = decontaminate.find_contaminated(documents(spark, [fits, other, item]), bench(spark, item))
    assert {r.doc_id for r in found.collect()} == {0, 2}


QUESTION = "Tom has 3 red apples and 5 green pears. Tom buys 4 more apples on Monday. How many pieces of fruit does Tom have now"


def again(text, **new):
    for a, b in new.items():
        text = re.sub(rf"\b{a.strip('_')}\b", b, text)
    return text


def test_several_copies_in_one_document(spark):
    one = again(QUESTION, Tom="Anna", _3="7", _5="9", _4="2")
    two = again(QUESTION, Tom="Peter", _3="12", _5="31", _4="6")
    mixed = " ".join(again(s, Tom=n) for s, n in zip(QUESTION.split(". "), ("Anna", "Peter", "Kim")))
    texts = [
        one, f"{one}. {two}", f"{filler(40, 1)} {one} {filler(70, 2)} {two} {filler(9, 3)} {one}", f"{two}. {QUESTION}", QUESTION.upper(), QUESTION.lower(),
        mixed, again(QUESTION, Tom="Anna").replace("more", "more of the"), filler(300, 5), QUESTION.replace(" ", "  \n"),
    ]
    got = {r.doc_id: r for r in decontaminate.find_contaminated(documents(spark, texts), bench(spark, QUESTION)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7, 9}
    assert {i for i, r in got.items() if r.reparameterised} == {0, 1, 2, 7}


def test_short_and_numeric_items(spark):
    items = ["Paris is the capital of France", "Why not", "1 2 3 5 8 13 21 34 55 89", "yes", "12"]
    texts = ["the answer is: Paris is the capital of France, they say", "paris is the capital of france", "why not", "but why not ask", "so 1 2 3 5 8 13 21 34 55 89 it goes", "so 9 2 3 5 8 14 21 34 57 89 it goes", "Yes!", "12", "13", None, ""]
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(documents(spark, texts), bench(spark, *items, None, "")).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (4, 2), (6, 3), (7, 4)}


def brute_template(text):
    """Tokens as (reading with names as words, with names as placeholders, value)."""
    low = lambda x: x.lower()
    t = re.sub(r"(?<![^\W_])([A-Z\u00c0-\u00d6\u00d8-\u00de][a-z\u00df-\u00f6\u00f8-\u00ff]+)", "\x01n\\1", text)
    t = re.sub(r"(?<![^\W_])(?<!\x01)([0-9]+(?:[.,][0-9]+)*)", " \x01d\\1 ", t)
    t = re.sub(rf"([0-9] {{1,2}})({decontaminate.UNITS})(?![^\W_])", "\\1\x01u\\2", t)
    out = []
    for x in re.sub("[!-/:-@\\[-`{-~\u00a1\u00ab\u00b7\u00bb\u00bf]+", "", low(t)).split():
        y = re.sub("\x01([du]).*", "\x01\\1", x)
        out.append((y.replace("\x01n", ""), re.sub("\x01n.*", "\x01n", y), x))
    return out


def brute_found(text, item, coverage=0.5):
    """Is the item in the text, by trying every shift, every band of shifts,
    and value for value anywhere?"""
    d, b = brute_template(text or ""), brute_template(item or "")
    size = min(len(b), decontaminate.WINDOW)
    if not size:
        return False
    at = range(len(d) - size + 1) if size >= decontaminate.SHORTEST else [0] if len(d) == size else []
    first, windows = {}, []
    for p in range(len(b) - size + 1):
        a, n, v = ([x[k] for x in b[p : p + size]] for k in range(3))
        readings = []
        few = min(sum(not x.startswith("\x01") for x in r) for r in (a, n)) < decontaminate.LITERALS
        for reading, is_slot in ((a, lambda x: x[:2] in ("\x01d", "\x01u")), (n, lambda x: x[:1] == "\x01")):
            if sum(not x.startswith("\x01") for x in reading) >= decontaminate.LITERALS:
                readings.append((tuple(reading), [x if is_slot(x) else "" for x in v]))
        if few:
            readings.append((("value", *(re.sub("\x01[dun]", "", x) for x in v)), [""] * size))
        for r, slots in readings:
            if r not in first:
                first[r] = p
                windows.append((p, r, slots, is_slot))
    total = len({p for p, *_ in windows})
    hits = []
    for q in at:
        a, n, v = ([x[k] for x in d[q : q + size]] for k in range(3))
        for p, r, slots, _ in windows:
            mine = None
            if r == ("value", *(re.sub("\x01[dun]", "", x) for x in v)):
                mine = [""] * size
            elif r == tuple(a):
                mine = [x if x[:2] in ("\x01d", "\x01u") else "" for x in v]
            elif r == tuple(n):
                mine = [x if x[:1] == "\x01" else "" for x in v]
            if mine is not None:
                hits.append((p, q - p, {(x, y) for x, y in zip(slots, mine) if x}, slots == mine))
    places = [[h for h in hits if h[3]]]
    for s in {h[1] for h in hits}:
        places += [[h for h in hits if h[1] == s and True], [h for h in hits if h[1] // 16 == s // 16], [h for h in hits if (h[1] + 8) // 16 == (s + 8) // 16]]
    for n, place in enumerate(places):
        pairs = set().union(*(h[2] for h in place))
        if (n == 0 or len({x for x, _ in pairs}) == len(pairs)) and len({h[0] for h in place}) >= max(1, coverage * total):
            return True
    return False


def test_decontamination_equals_trying_every_place(spark):
    rng = np.random.default_rng(14)
    items = [QUESTION, PASSAGE, "Paris is the capital of France", "add 4 to 9 then take 4 from 9 and write 4 beside 9", "1 2 3 5 8 13 21 34 55 89", "la la la la la la la la la la 7 la"]
    values = ["3", "5", "4", "17", "2,5", "Anna", "Tom", "Peter", "tom", "km"]
    texts = []
    for _ in range(150):
        words = str(rng.choice(items)).split()
        for k in range(int(rng.integers(0, 9))):
            i = int(rng.integers(0, len(words)))
            words[i : i + int(rng.integers(0, 2))] = [str(rng.choice(values))]
        texts.append(" ".join([filler(int(rng.integers(0, 5)), 7), *words, *(str(rng.choice(items)).split()[: int(rng.integers(0, 30))])]))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_contaminated(documents(spark, texts), bench(spark, *items)).collect()}
    want = {(i, k) for i, t in enumerate(texts) for k, item in enumerate(items) if brute_found(t, item)}
    assert got == want


def test_clashing_columns_and_null_ids(spark):
    docs = documents(spark, [PASSAGE, "fine"]).withColumns({c: F.lit("x") for c in ("_found", "_s", "_a", "w", "pos", "item_id", "place")})
    docs = docs.union(docs.where("text = 'fine'").withColumn("doc_id", F.lit(None).cast("long")))
    left = decontaminate.remove_contaminated(docs, bench(spark, PASSAGE))
    assert left.columns == docs.columns and sorted((r.doc_id, r._found) for r in left.collect() if r.doc_id is not None) == [(1, "x")] * 2
    assert left.where("doc_id IS NULL").count() == docs.where("doc_id IS NULL").count()


def test_decontamination_by_shuffle_gives_the_same(spark, sf):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    a = sorted(as_rows(decontaminate.find_contaminated(docs, items)))
    b = sorted(as_rows(decontaminate.find_contaminated(docs, items, broadcast_rows=0)))
    assert a == b
    plain = {r.item_id: " ".join(re.findall(r"\w+", r.text.lower())) for r in items.collect()}
    assert a
    whole = {(r.doc_id, i) for r in docs.collect() for i, t in plain.items() if r.text and t in " ".join(re.findall(r"\w+", r.text.lower()))}
    assert whole <= {(x[0], x[1]) for x in a} and {x[0] for x in a} == {d for d, _ in whole}


def test_language_id_on_held_out_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tries = langid.learn(docs.where(outside_fold("doc_id", 4, 2)))
    got = langid.predict(docs, tries, in_fold("doc_id", 4, 2)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.predict(documents(spark), tries, F.lit(False)).collect()}
    for i, t in enumerate(ODD_TEXTS):
        assert (odd[i].lang_pred == "und") == (t is None or not any(map(str.isalpha, t)))
    assert {r.lang_pred for r in langid.predict(documents(spark), {}, F.lit(False)).collect()} == {"und"}
    assert langid.learn(documents(spark, [])) == {}


def test_language_predictions_equal_direct_coding(spark):
    """Each text coded symbol by symbol under each language's counts."""
    from .test_ppm_boost import brute_bits

    rng = np.random.default_rng(6)
    alphabets = {"aa": "abcd ", "bb": "abce  ", "cc": "xyzab "}
    text = lambda lang, n: "".join(rng.choice(list(alphabets[lang]), n))
    rows = [(i, text(lang, 300), lang) for i, lang in enumerate([*alphabets] * 3)] + [(90, None, "aa"), (91, "zz", None)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    tries = langid.learn(train)
    counts = {lang: {} for lang in alphabets}
    for _, t, lang in rows:
        for w in (t or "").encode().split() if lang else ():
            counts[lang][w] = counts[lang].get(w, 0.0) + 1
    asked = [text(lang, 40) for lang in alphabets for _ in range(4)] + ["q", "ab" * 60, "12 34", ""]
    for r in langid.predict(documents(spark, asked), tries, F.lit(True)).collect():
        t = asked[r.doc_id]
        if not any(map(str.isalpha, t)):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        bits = {lang: sum(brute_bits(list(c), list(c.values()), 4, w) for w in t.encode().split()) for lang, c in counts.items()}
        assert r.lang_pred == min(sorted(bits), key=bits.get) and np.isclose(r.bits, min(bits.values()))
        assert np.isclose(r.score, 1 / sum(2.0 ** (min(bits.values()) - b) for b in bits.values()))


def test_language_of_repeated_rows_and_one_language(spark):
    train = documents(spark, ["so it is written here"] * 3).select("doc_id", "text", "lang")
    tries = langid.learn(train.union(train))
    assert list(tries) == ["en"] and tries["en"].levels[0][1].sum() == langid.learn(train).get("en").levels[0][1].sum()
    assert {r.lang_pred for r in langid.predict(documents(spark, ["was", "1"]), tries, F.lit(True)).where("doc_id = 0").collect()} == {"en"}


def brute_features(text):
    """The features one by one, from the definition of each."""
    out = [sum(b in c for b in text) / max(len(text), 1) for c in map(set, quality.CLASSES)]
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w, k, n = max(len(words), 1), max(len(lines), 1), max(len(text), 1)
    ends = sum(text.count(x) for x in (b".", b"!", b"?"))
    letters = max(out[0] + out[1] + out[24], 1e-9)
    shares = [text.count(bytes([b])) / n for b in range(256)]
    longest = 0
    for x in words:
        longest = max(longest, len(x))
    out += [np.log(1 + len(text)), np.log(1 + len(words)), len(text) / w, len(set(words)) / w, len(set(words)) / w**0.7, sum(a == b for a, b in zip(words, words[1:])) / w]
    return out + [-sum(p * np.log2(p) for p in shares if p), len(set(lines)) / k, np.log(1 + len(text) / k), ends / w, np.log(1 + w / max(ends, 1)), 1 - letters, out[1] / letters, longest]


def test_quality_equals_a_plain_version(spark):
    """Features one by one; the weights' pairwise loss has no slope left that
    matters; score and cut by the formula; op8's rows by the same model."""
    texts = [(t or "").encode() for t in ODD_TEXTS] + [filler(30 + 7 * k, k).encode() + b". So?\n" * k for k in range(30)]
    for t in texts:
        assert np.allclose(quality.features(t), brute_features(t))
    rng = np.random.default_rng(3)
    x = np.stack([quality.features(t) for t in texts])
    y = (rng.random(len(texts)) < 0.4 + 0.4 * (x[:, 0] > np.median(x[:, 0]))).astype(float)
    model = quality.RankingModel(x, y, pairs=2_000, rounds=3_000)
    z = model._expand(x)
    draw = np.random.default_rng(8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    diff = z[draw.choice(good, 2_000)] - z[draw.choice(bad, 2_000)]
    loss = lambda v: np.log1p(np.exp(-(diff @ v))).mean() + 0.5e-4 * v @ v
    assert loss(model.weight) < loss(np.zeros_like(model.weight)) - 0.05
    for k in range(0, len(model.weight), 7):
        for step in (0.05, -0.05):
            moved = model.weight.copy()
            moved[k] += step
            assert loss(moved) > loss(model.weight) - 2e-3
    s = z @ model.weight
    assert np.isclose(model.cut, np.quantile(s, 1 - (y.sum() + 0.5) / (len(y) + 1)))
    assert np.allclose(model.probability(x), [1 / (1 + np.exp(-model.slope * (v - model.cut))) for v in s])
    got = {r.doc_id: r.score for r in quality.score(documents(spark, [t.decode() for t in texts]), model, F.lit(False)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], model.probability(x))


def test_quality_labels_of_one_kind_and_repeated_rows(spark):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (None, 0), (2, 7), (3, None)], "doc_id long, quality int")
    docs = documents(spark, ["so it goes", "x y z", "a", "b"])
    one = quality.learn(docs, labels, F.lit(True))
    assert {r.score for r in quality.score(docs, one, F.lit(False)).collect()} == {2.5 / 3}
    both = labels.union(spark.createDataFrame([(1, 0)], labels.schema))
    a, b = quality.learn(docs, both, F.lit(True)), quality.learn(docs.union(docs).union(docs), both, F.lit(True))
    assert (a.weight == b.weight).all() and a.base == b.base


def test_quality_on_held_out_documents(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    model = quality.learn(docs, labels, outside_fold("doc_id", 3, 1))
    got = quality.score(docs, model, in_fold("doc_id", 3, 1)).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    odd = quality.score(documents(spark), model, F.lit(False)).collect()
    assert len(odd) == len(ODD_TEXTS) + 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    kept = quality.keep_good(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == sum(r.predicted for r in odd)
    assert quality.learn(documents(spark, []), labels, F.lit(True)) is None
    assert {r.score for r in quality.score(documents(spark), None, F.lit(False)).collect()} == {0.5}


def test_quality_sees_a_long_word_anywhere():
    for at in (10, 4095, 4096, 9000):
        words = [b"word"] * 10_000
        words[at] = b"x" * 500
        assert quality.features(b" ".join(words))[-1] == 500


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host) :]).group()


def brute_rule(host, path):
    fits = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def test_url_filter_parses_and_rules(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/7?x#y", "http://a.example.com/en/70", "http://example.com", "http://com/en/", "http://xcom/en/", "http://example.net/de/8", "http://x.net/de/9", "ftp://b.org?/es/", "a://b://c/d", "http://\u00c4X.com/en/\nz", "http://h/" + "p" * 5000]
    real = [r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("url").collect()]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(odd + real + [odd[4]])], "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "score": F.lit(3)})
    got = urlfilter.judge(pages, URL_RULES).collect()
    assert len(got) == len(odd) + len(real) + 1
    urls = odd + real + [odd[4]]
    for r in got:
        host, path = brute_url(urls[r.page_id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    assert as_rows(urlfilter.judge(pages.limit(0), URL_RULES)) == []


def test_url_trees_learn_labels(spark):
    rng = np.random.default_rng(2)
    rows = [(i, f"http://s{rng.integers(50)}.example.{'xyz' if i % 2 else 'org'}/{'a/' * int(rng.integers(1, 4))}{rng.integers(10**6)}", i % 2) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, y int")
    got = urlfilter.judge(pages, [], labelled=F.when(F.col("page_id") < 400, F.col("y"))).collect()
    assert np.mean([(r.verdict == "block") == bool(r.page_id % 2) for r in got if r.page_id >= 400]) > 0.95


def test_url_scores_equal_asking_each_tree(spark):
    rng = np.random.default_rng(9)
    rows = [(i, f"http://{'ab'[i % 2]}{rng.integers(9)}.example.{'net' if rng.random() < 0.5 else 'org'}/{'de' if rng.random() < 0.5 else 'es'}/{rng.integers(10**4)}") for i in range(300)]
    pages = spark.createDataFrame(rows + rows[:40], "page_id long, url string")
    known = [u for _, u in rows if brute_rule(*brute_url(u))[0]]
    known = sorted(set(known))
    model = urlfilter.UrlModel.fit([(u, *brute_url(u)) for u in known], np.array([float(brute_rule(*brute_url(u))[1] == "block") for u in known]))
    for r in urlfilter.judge(pages, URL_RULES).collect():
        url = dict(rows)[r.page_id]
        x, raw = model.features(url, *brute_url(url)), model.trees.base
        for asked, value in model.trees.trees:
            raw += value[sum((x[f] > edge) << level for level, (f, edge) in enumerate(asked))]
        assert abs(r.score - 1 / (1 + np.exp(-raw))) < 0.05  # the order of training rows may turn a tie


NAIVE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in NAIVE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark, sf):
    rng = np.random.default_rng(5)
    odd = ["".join(rng.choice(list("0123456789.+-@ ()ab%\n"), int(rng.integers(1, 60)))) for _ in range(4000)]
    odd += ["".join(rng.choice(list("0129."), int(rng.integers(1, 40)))) for _ in range(2000)] + ["".join(rng.choice(list("a@.-"), int(rng.integers(1, 20)))) for _ in range(2000)]
    odd += ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "4111 1111 1111 1111", "+1 (269) 555-3296.", "00000000001.1.1.1", "9" * 3000, "1.." * 50, "@" * 50]
    odd += [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    for text in odd:
        assert pii.base_spans(text) == brute_spans(text), text
    for long_ in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000):
        pii.base_spans(long_)


def test_pii_scan_and_redaction(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = pii.learn(docs)
    mine = documents(spark, [*ODD_TEXTS, "mail bob@x.example.com or 10.0.0.1 now", "\U0001f600 +1 (269) 555-3296"])
    got = {r.doc_id: r for r in pii.scan(mine, model).collect()}
    n = len(ODD_TEXTS)
    assert (got[n].n_email, got[n].n_ip) == (1, 1) and got[n].spans.startswith("email:5:22")
    assert got[n + 1].spans == "phone:2:19" and got[0].spans == ""
    texts = {r.doc_id: r.text for r in pii.redact(mine, model).collect()}
    assert texts[n] == "mail <EMAIL> or <IP> now" and texts[0] is None and texts[4] == "one"
    assert pii.redact(mine, model).columns == mine.columns
    assert as_rows(pii.scan(documents(spark, []), pii.learn(documents(spark, [])))) == []


def pii_model(spark):
    if not hasattr(pii_model, "made"):
        pii_model.made = pii.learn(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    return pii_model.made


PLANTED = {
    "phone": ["269 555 3296", "(269) 555 3296", "269-555-3296", "0049 30 1234567", "1 803 555 4188"],
    "email": ["bob (at) mail (dot) example (dot) com", "jane.roe[at]uni[dot]edu", "max at mail dot example dot org", "eva @ mail.example.net"],
    "ip": ["10[.]20[.]30[.]40", "192(.)168(.)1(.)17"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "4111 1111 1111 1111 48213377", "7302 4111111111111111"],
}
CLEAN = ["on 2024-01-02 at 10:30:45", "version 1.2.3.4000", "look at dot com", "total 1,234,567.89 of 3.14159265", "at last. There it is", "id 473696257 and 8490294829394200", "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", "from 1990 1995 2000 2005", "meet at noon. Then", "999.888.777.666"]


def test_pii_trees_add_planted_forms_and_leave_others(spark):
    model = pii_model(spark)
    hits = total = 0
    for kind, forms in PLANTED.items():
        for form in forms:
            text = f"please write it down: {form} and tell nobody"
            base, more = pii.find(text, model)
            total += 1
            hits += any(k == kind and text[a:b] in form and len(text[a:b]) > 9 for k, a, b in more)
            assert all(k == kind for k, _, _ in base + more), (form, base, more)
    assert hits / total >= 0.9, hits
    for text in CLEAN:
        assert pii.find(f"so {text} they say", model) == ([], []), text


def test_pii_added_spans_are_disjoint_and_follow_the_scores(spark):
    model = pii_model(spark)
    rng = np.random.default_rng(3)
    forms = [f for x in PLANTED.values() for f in x] + CLEAN + ["a@b.example.org", "+1 (269) 555-3296", "10.0.0.1"]
    for _ in range(200):
        text = " ".join(f"{rng.choice(forms)} word" for _ in range(int(rng.integers(1, 9))))
        base, more = pii.find(text, model)
        assert base == brute_spans(text)
        # by definition: the best proposal that meets nothing taken, again and again
        left = [s for s in pii.proposals(text) if pii.valid(s[0], text[s[1] : s[2]]) and not any(s[1] < b and a < s[2] for _, a, b in base)]
        scores = model.trees.probability(np.array([pii.describe(text, s) for s in left])) if left else []
        want = []
        for p, n in sorted((-p, n) for n, p in enumerate(scores)):
            s = left[n]
            if -p >= model.thresholds[s[0]] and not any(s[1] < b and a < s[2] for _, a, b in want):
                want.append(s)
        assert more == sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


def test_pii_adds_spans_on_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = pii.scan(docs, pii_model(spark)).where("n_added > 0").collect()
    assert 0 < len(got) < 0.01 * docs.count()
    texts = {r.doc_id: r.text for r in docs.join(spark.createDataFrame([(r.doc_id,) for r in got], "doc_id long"), "doc_id").collect()}
    for r in got:
        base = set(brute_spans(texts[r.doc_id]))
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(","))]
        added = [s for s in spans if s not in base]
        assert base <= set(spans) and len(added) == r.n_added
        assert all(pii.valid(k, texts[r.doc_id][a:b]) for k, a, b in added)


def test_pii_of_very_long_texts(spark):
    import time

    model = pii_model(spark)
    line = "2024-01-02 10:30:45 host 10.1.2.3 user a@b.com id 473696257 call 269 555 3296\n"
    for text in (line * (5_000_000 // len(line)), "1 " * 2_000_000, "9" * 5_000_000, "1234 " * 1_000_000, "a at " * 1_000_000):
        began = time.time()
        pii.find(text, model)
        assert time.time() - began < 25
