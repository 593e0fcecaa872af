"""Rules, languages, page text, rankings, mixing: against brute force, held-out rows and fixed cases."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from headgrid.llm import common, html_extract, langid, mixing, quality_rank, quality_rules, toxicity

SMALL = "/root/testdata/sf0.01"
EDGE = [(1, None), (2, ""), (3, " \n"), (None, "a b"), (4, "one two"), (4, "one two"), (5, "word " * 30_000)]
NO_LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in EDGE], "doc_id long, text string, lang string, score string")


def slow_counts(text):
    text = text or ""
    spaces = " \t\n\v\f\r"
    words, word = [], ""
    for c in text + " ":
        if c in spaces:
            words += [word] if word else []
            word = ""
        else:
            word += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            hit |= set(range(i, i + 5))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in spaces for c in line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_base_counts_equal_brute_force():
    draw = random.Random(1)
    texts = [None, "", "\n\n", "a b c d e", "a b c d e a b c d e"]
    texts += [draw.choice([" ", "\n", "\t"]).join(draw.choices(["a", "b", "é#", "|", "\n", "\x0b"], k=draw.randint(0, 40))) for _ in range(300)]
    assert [quality_rules.base_counts(t) for t in texts] == [slow_counts(t) for t in texts]


def test_bands_reject_repetition_and_noise():
    draw = random.Random(2)
    prose = " ".join("".join(draw.choices(["in", "er", "the", "on", "ed", "ing"], k=draw.randint(1, 4))) for _ in range(1500))
    noise = " ".join("".join(chr(draw.randint(33, 126)) for _ in range(9)) for _ in range(800))
    assert quality_rules.judge(prose)[6]
    assert not quality_rules.judge(noise)[6]
    assert not quality_rules.compression("abcd efgh " * 500)[0]
    mixed = prose[:8192] + "a b c d e f g " * 600  # whole text within its band, many chunks are not
    assert quality_rules.compression(mixed)[3] > 0


@pytest.mark.parametrize("bands", [quality_rules.BANDS, quality_rules.CORPUS_BANDS])
def test_every_band_rejects_noise_and_repetition(bands):
    draw = random.Random(4)
    signs, base62 = [chr(c) for c in range(32, 127)], [chr(c) for c in range(48, 123) if chr(c).isalnum()]
    for size, _, _ in bands.whole:
        noise = "".join(draw.choices(signs, k=size))
        words = " ".join("".join(draw.choices(base62, k=draw.randint(3, 10))) for _ in range(size // 4))[:size]
        again = ("".join(draw.choices(base62, k=12)) + " ") * (size // 13 + 1)
        assert not quality_rules.compression(noise, bands)[0], size
        assert not quality_rules.compression(again[:size], bands)[0], size
        assert size < 192 or not quality_rules.compression(words, bands)[0], size


def test_corpus_bands_decide(docs, labels):
    rows = quality_rules.quality_rules(docs, bands=quality_rules.CORPUS_BANDS).join(labels, "doc_id").where("not base_failed")
    found = {r["quality"]: r for r in rows.groupBy("quality").agg(F.count("*").alias("n"), F.sum((~F.col("kept")).cast("int")).alias("out")).collect()}
    assert found[1]["out"] <= 0.01 * found[1]["n"] and found[0]["out"] >= 0.3 * found[0]["n"]


def test_rules_edges(spark, edge):
    rows = quality_rules.quality_rules(edge).collect()
    assert len(rows) == len(EDGE) and not any(r["kept"] for r in rows)
    assert quality_rules.quality_rules(edge.limit(0)).collect() == []
    assert quality_rules.keep_good(edge).columns == edge.columns


def test_rules_keep_documents_labelled_good(docs, labels):
    found = quality_rules.quality_rules(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed")
    assert found.where("not kept").count() == 0 and found.count() > 100


def test_language_held_out(docs):
    found = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id")
    row = found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and 0 <= row[1] and row[2] <= 1
    assert found.where("held_out").count() == sum(zlib.crc32(str(r[0]).encode()) % 3 == 1 for r in docs.select("doc_id").collect())


def test_votes_of_pairs_equal_brute_force():
    draw = random.Random(12)
    for n in (2, 3, 4, 7):
        for _ in range(200):
            margin = {(i, j): draw.choice([-2.0, -1.0, -0.5, 0.5, 1.0, 2.0]) for i in range(n) for j in range(i + 1, n)}
            own = [[margin[i, j] if i < j else -margin[j, i] for j in range(n) if j != i] for i in range(n)]
            order = sorted(range(n), key=lambda i: (-sum(m > 0 for m in own[i]), -sum(own[i]), i))
            assert langid.elect(n, np.array([margin[k] for k in sorted(margin)])) == (order[0], min(own[order[0]]))


def test_three_close_languages(spark):
    """Languages of one family that share most of their words; each pair has words of its own."""
    draw = random.Random(8)
    shared = ["".join(draw.choice("aeioudnrstlm") for _ in range(draw.randint(2, 7))) for _ in range(80)]
    marks = {"da": ["hvad", "kage", "bage"], "no": ["hva", "kake", "bake"], "sv": ["vad", "kaka", "baka"], "fr": ["quoi", "gâteau"]}
    rows = []
    for i in range(800):
        lang = draw.choice(list(marks))
        rows.append((i, lang, " ".join(draw.choice(shared) if draw.random() < 0.8 else draw.choice(marks[lang]) for _ in range(40))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit_language_model(docs)
    names, machines = model.languages["germanic"]
    assert names == ["da", "no", "sv"] and len(machines) == 3 and len(model.languages["romance"][1]) == 0
    found = langid.language_id(docs.repartition(3)).where("held_out").join(docs, "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 200 and right / n > 0.97


def test_many_languages_and_repeated_ids_stay_bounded(spark):
    rows = [(i, f"l{i % 300:03d}", "abc def") for i in range(1200)] + [(5000, "l000", f"text {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    sample, weights = common.bounded_sample(docs, "lang", "doc_id", 1000, max_classes=40, max_rows=80)
    assert len(weights) == 40 and sample.count() <= 160
    assert len(langid.fit_language_model(docs.where("lang < 'l003'")).families) == 3


def test_language_edges(spark, docs, edge):
    model = langid.fit_language_model(docs)
    got = [(r["lang_pred"], r["score"]) for r in langid.predict_language(edge, model, ("doc_id",)).collect()]
    assert got[:3] == [("und", 0.0)] * 3 and got[4][0] != "und"
    assert langid.predict_language(spark.createDataFrame([(1, "12 34 !")], "doc_id long, text string"), model).first()["lang_pred"] == "und"
    empty = docs.limit(0)
    assert langid.language_id(empty).collect() == []
    unlearned = langid.language_id(edge.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlearned.collect()} == {"und"}
    assert model.families == ["germanic", "romance"]


def test_toxicity_separates_planted_insults(spark):
    draw = random.Random(3)
    plain = [f"{a}{b}" for a in ("ba", "do", "ke", "mi") for b in ("ra", "lo", "tu", "ni")]
    rows, marks = [], []
    for i in range(600):
        words = draw.choices(plain, k=draw.randint(20, 200))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(len(words) // 20 + 1):
                words[draw.randrange(len(words))] = draw.choice(["zoink!", "grub", "Snark,"])
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, NO_LABELS)
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.where("predicted = toxic").count() / found.count() > 0.95
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, labels).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-9 for r in found.collect())


def test_toxicity_keeps_rare_insults(spark):
    draw = random.Random(6)
    plain = [f"{a}{b}{c}" for a in ("ba", "do", "ke", "mi") for b in ("ra", "lo", "tu", "ni") for c in "lmnrst"]
    rows = [(i, " ".join(draw.choices(plain, k=30) + ["zoink"] * (i % 200 == 0) + ["often"] * (i % 10 == 0))) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(3000)], NO_LABELS)
    ratios = toxicity.fit_toxicity(docs, labels, F.lit(True)).ratios
    assert ratios["zoink"] > 1 and ratios["often"] > 1 and max(abs(ratios[w]) for w in plain) < 0.5


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), (F.col("id") % 7).cast("string")).alias("text"))
    labels = rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    seen, fit_model, fit_curve = [], toxicity.fit_model, toxicity.fit_curve
    monkeypatch.setattr(toxicity, "fit_model", lambda rows, *a: [seen.append(rows.count()), fit_model(rows, *a)][1])
    monkeypatch.setattr(toxicity, "fit_curve", lambda points, *a: [seen.append(points.count()), fit_curve(points, *a)][1])
    toxicity.fit_toxicity(rows, labels, common.crc_fold("doc_id", 5) != 0)
    assert len(seen) == 2 and sum(seen) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(30_000))


def test_toxicity_curve_equals_newton_over_all_rows(spark):
    draw = random.Random(5)
    points = [(x, draw.random() < 1 / (1 + math.exp(-4 * x))) for x in (draw.uniform(-1, 1) for _ in range(500))]
    got = toxicity.fit_curve(spark.createDataFrame(points, "x double, label_ boolean").repartition(7))
    x, y = np.array([p[0] for p in points]), np.array([float(p[1]) for p in points])
    z = np.stack([np.ones(len(x)), x / x.std()], axis=1)
    p = common.sigmoid(z @ (got * [1, x.std()]))
    assert np.abs(z.T @ (y - p) - 1e-4 * len(x) * got * [1, x.std()]).max() < 1e-3
    assert toxicity.fit_curve(spark.createDataFrame([(1.0, True)], "x double, label_ boolean")) is None


def test_toxicity_equals_brute_force(spark):
    """Both models written out as probabilities of every word, the unseen one included."""
    draw = random.Random(21)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(400):
        words = draw.choices(vocabulary, weights=[1 / (k + 1) for k in range(60)], k=draw.randint(0, 30))
        toxic = draw.random() < 0.3
        if toxic and draw.random() < 0.7:
            words += draw.choice([["You", "fool!"], ["fool", "w3"], ["odd", f"once{i}"]])
        rows.append((" ".join(words) if words else None, toxic))
    model = toxicity.fit_model(spark.createDataFrame(rows, "text string, label_ boolean").repartition(4))

    counts = {}
    for text, toxic in rows:
        words = [w.strip("!").lower() for w in (text or "").split()]
        for word in set(words):
            before = {a for a, b in zip([None] + words, words) if b == word}
            counts.setdefault(word, [0, 0])[0 if toxic else 1] += min(2, len(before))
    total = [sum(c[k] for c in counts.values()) for k in (0, 1)]

    def discount(k):
        n = [max(1, sum(c[k] == i for c in counts.values())) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
        return [min(max(x, lo), hi) for x, lo, hi in zip(raw, (0.3, 0.6, 0.8), (0.98, 1.9, 2.8))]

    less = [discount(0), discount(1)]

    def chance(word, k):
        own = {}
        for w, c in counts.items():
            expected = sum(c) * total[k] / sum(total)
            own[w] = max(0.0, c[k] - less[k][min(max(c[k], 1), 3) - 1] - expected - toxicity.NOISE * expected**0.5) / total[k]
        shared = (sum(counts.get(word, [0, 0])) + 0.5) / (sum(total) + 0.5 * (len(counts) + 1))
        return own.get(word, 0.0) + (1 - sum(own.values())) * shared

    for k in (0, 1):
        assert math.isclose(sum(chance(w, k) for w in [*counts, "unseen"]), 1, rel_tol=1e-9)
    for text in [r[0] for r in rows[:60]] + ["you FOOL! w3 never-seen fool", "", None, "... ,"]:
        words = [w for w in (text or "").lower().replace("!", "").split() if w not in ("...", ",")]
        want = sum(math.log(chance(w, 0) / chance(w, 1)) for w in words) / max(1, len((text or "").split())) ** toxicity.POWER
        assert math.isclose(model.difference(text), want, abs_tol=1e-9)
    assert model.ratios["fool"] > 1


def test_weak_evidence_of_rare_words_adds_up(spark):
    """Three words, each in 4 toxic and no ordinary documents of 3,000: none is dropped, together they tell."""
    draw = random.Random(9)
    plain = [f"{a}{b}{c}" for a in ("ba", "do", "ke", "mi") for b in ("ra", "lo", "tu", "ni") for c in "lmnrst"]
    rows = [(" ".join(draw.choices(plain, k=30) + [f"bad{i // 10 % 3}"] * 2 * (i % 10 == 0 and i < 120)), i % 10 == 0) for i in range(3000)]
    model = toxicity.fit_model(spark.createDataFrame(rows, "text string, label_ boolean"))
    one, three = model.difference("bad0 " + rows[1][0]), model.difference("bad0 bad1 bad2 " + rows[1][0])
    assert min(model.ratios[f"bad{k}"] for k in range(3)) > 0.5 and three > 2 * one - 0.1 > model.difference(rows[1][0])


def test_quality_rank_held_out(docs, labels):
    found = quality_rank.quality_rank(docs, labels).join(labels, "doc_id").where("held_out")
    assert found.where("predicted = quality").count() / found.count() > 0.97


def _stats_frame(spark, stats, good):
    rows = [(*map(float, s), bool(g)) for s, g in zip(stats, good)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in quality_rank.STAT_NAMES) + ", good boolean").repartition(5)


def test_quality_learns_from_all_pairs_of_labelled_rows(spark):
    """Model, steps and cut against every pair and every threshold written out."""
    draw = np.random.default_rng(4)
    stats, good = np.round(draw.normal(size=(150, quality_rank.N_STATS)), 2), draw.random(150) < 0.7
    stats[good, 0] += 1
    rows = _stats_frame(spark, stats, good)
    model = quality_rank.fit_quality(rows)
    assert np.allclose(model.edges, np.quantile(stats, np.linspace(0, 1, quality_rank.STEPS + 2)[1:-1], axis=0).T)
    assert np.allclose(model.mean, stats.mean(axis=0)) and np.allclose(model.scale, stats.std(axis=0))
    x = model.features(stats)
    better = (x[good][:, None] - x[~good][None]).reshape(-1, x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = common.sigmoid(-(better @ w))
        w = w + np.linalg.solve((better * (p * (1 - p))[:, None]).T @ better / len(better) + 0.01 * np.eye(len(w)), better.T @ p / len(better) - 0.01 * w)
    assert np.abs(model.weights - w).max() < 0.02 and np.corrcoef(x @ w, x @ model.weights)[0, 1] > 0.9999
    ranks = x @ model.weights
    errors = [((ranks > c) != good).sum() for c in [ranks.min() - 1, *ranks]]
    assert ((ranks > model.cut) != good).sum() == min(errors)
    assert np.isclose(model.spread, ranks.std() / 4)
    assert quality_rank.fit_quality(rows.where("good")) is None and quality_rank.fit_quality(rows.limit(0)) is None


def test_quality_counts_every_labelled_row(spark, monkeypatch):
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    seen = []
    monkeypatch.setattr(quality_rank, "fit_quality", lambda rows, *a: seen.append(rows.count()))
    assert {r["score"] for r in quality_rank.quality_rank(docs, labels).collect()} == {0.5}
    assert seen == [sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(12_000))]


def test_best_cut_equals_every_threshold(spark):
    draw = random.Random(8)
    for n in (1, 2, 60):
        rows = [(draw.choice([0.5, -1.25, draw.gauss(0, 1)]), draw.random() < 0.6) for _ in range(n)]
        ranks = sorted({r for r, _ in rows})
        gaps = list(zip([ranks[0] - 1, *ranks], [*ranks, ranks[-1] + 1]))
        wrong = [sum(g if r <= low else not g for r, g in rows) for low, _ in gaps]
        low, high = max((g for g, k in zip(gaps, wrong) if k == min(wrong)), key=lambda g: (g[1] - g[0], -g[0]))
        assert math.isclose(quality_rank.best_cut(spark.createDataFrame(rows, "rank double, good boolean").repartition(3)), (low + high) / 2)


@pytest.mark.parametrize("run", [toxicity.toxicity, quality_rank.quality_rank])
def test_rankers_edges(spark, docs, labels, edge, run):
    rows = run(edge, labels).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], NO_LABELS)
    assert len({r["score"] for r in run(edge, none).collect()}) == 1
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (99, 0, 1), (2, 1, 0), (2, 1, 0)], NO_LABELS)
    assert run(edge, odd).count() == len(EDGE)
    assert run(docs.limit(0), labels).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if(a<b){"</p>"}</script></head><body>
<nav><ul><li><a href="/a">menu</a></ul></nav><div id="header">site</div><div class="cookie-notice">cookies</div>
<article><h1>Head &amp; more</h1><p><b>One<br>two&nbsp; three<p>Four <span class="ad">buy</span>five</p><ul><li>a<li>b</ul>
<section class="comments"><p>first!</p></section><form><p>mail</p></form></article><div class="sidebar">side</div><footer>&copy; x</footer></body></html>"""


def test_page_text():
    assert html_extract.main_text(PAGE, set(), set()) == "Head & more\nOne two three\nFour five\na\nb"
    for cut in range(len(PAGE)):
        html_extract.main_text(PAGE[:cut], set(), set())


def test_class_names_of_wrappers_do_not_drop_articles():
    story = "<p>The story &amp; its end.</p>"
    pages = [
        f"<div class='content has-sidebar'><article>{story}</article></div>",
        f"<div class='post comments-open'><article>{story}</article></div>",
        f"<article><div class='elementor-widget text'>{story}</div></article>",
        f"<div class='widget'><section id='comments'><main>{story}</main></section></div>",
        f"<body class='no-sidebar sidebar'>{story}<div class='site-footer'>f</div><div id=sidebar_1>s</div></body>",
        f"<div class='sidebar'><p>s</p></div><div class='notice'><article>{story}</article></div>",
        f"<main>{story}</main><ol class='comment-list'><li><article>a reader</article></li></ol>",
        f"<div class='widget'><main>{story}</main><ol class='comments'><li><article>a reader</article></li></ol></div>",
        f"<nav><article>menu</article></nav><article>{story}<section class='comments'><p>c</p></section></article>",
    ]
    for page in pages:
        assert html_extract.main_text(page, set(), set()) == "The story & its end.", page
    assert html_extract.main_text("<article><p>Use the <button>Save</button> key</p><button>Buy</button></article>", set(), set()) == "Use the Save key"


def test_pages_and_templates(spark):
    body = "<html><body><div class='top'><p>Welcome to us</p><b>Call now</b></div><div><p>{0}</p><p>{1}</p></div><div><p>Imprint</p></div></body></html>"
    rows = [(i, f"https://h.example/{i}", body.format(f"story {i}", f"more {i * 7}"), "u") for i in range(6)]
    rows += [(10, None, None, "u"), (11, "bad", "", "u"), (None, "https://one.example/", "<p>alone", "u"), (0, "https://h.example/0", rows[0][2], "u")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {(r["page_id"], r["url"]): r["text"] for r in html_extract.extract_text(pages).collect()}
    assert got[(3, "https://h.example/3")] == "story 3\nmore 21"
    assert got[(10, None)] == got[(11, "bad")] == "" and got[(None, "https://one.example/")] == "alone"
    assert html_extract.extract_text(pages).count() == len(rows)
    assert html_extract.extract_text(pages.limit(0)).collect() == []


def test_template_with_an_inline_icon(spark):
    body = "<html><body><div><svg><path d='M0'/></svg><p>Welcome to us</p></div><div><p>{0}</p></div></body></html>"
    rows = [(i, f"https://h.example/{i}", body.format(f"story {i}")) for i in range(6)]
    got = html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in got) == [f"story {i}" for i in range(6)]


def test_template_text_inside_the_article(spark):
    body = "<html><body><main><h1>{0}</h1><p>{1}</p><p>Like what you read? Subscribe</p></main><div><p>Imprint</p></div></body></html>"
    texts = [f"a long story number {i} that no other page of the host tells" for i in range(4)] + ["one story that</p><p>several pages</p><p>copy word for word"] * 6
    rows = [(i, f"https://h.example/{i}", body.format(f"t {i}", t)) for i, t in enumerate(texts)]
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == f"t 1\n{texts[1]}" and all(part in got[i] for i in got for part in texts[i].split("</p><p>"))


def test_rates_equal_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for i in range(200):
        p = [draw.random() ** 3 for _ in range(3)]
        rows.append((i, draw.randint(0, 300), *[x / sum(p) for x in p]))
    mix = mixing.Mix(["a", "b", "c"], [], [])
    frame = spark.createDataFrame(rows, "id long, tokens long, p_0 double, p_1 double, p_2 double")
    targets = {"a": 0.9, "b": 0.1, "c": 0.0}
    got = {r["id"]: r["rate"] for r in mixing.fit_rates(frame, mix, targets, 1.2, steps=25).collect()}
    n = sum(r[1] for r in rows)
    goal = [1.2 * n * targets[k] for k in "abc"]
    share = [sum(r[1] * r[2 + k] for r in rows) / n for k in range(3)]
    rate = [1.0] * len(rows)
    for _ in range(len(mix.steps)):
        total = [sum(x * r[1] * r[2 + k] for x, r in zip(rate, rows)) for k in range(3)]
        rate = [max(0.0, x - sum(r[2 + k] * (total[k] - goal[k]) / (n * share[k]) for k in range(3))) for x, r in zip(rate, rows)]
    assert all(math.isclose(got[r[0]], x, abs_tol=1e-6) for r, x in zip(rows, rate))
    assert min(rate) >= 0 and any(x == 0 for x in rate)
    before, after = mix.totals["before"], mix.totals["after"]
    goals = mix.totals["goal"]
    assert sum((after[d] - goals[d]) ** 2 for d in goals) < 0.2 * sum((before[d] - goals[d]) ** 2 for d in goals)


def test_words_end_at_any_ascii_white_space(spark):
    text = "One\rtwo\r\nTHREE\x0bfour\x0cfive\tsix seven\u00a0still "
    got = spark.createDataFrame([(text,), (None,), (" \r\n",)], "t string").select(mixing.words_of(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [["one", "two", "three", "four", "five", "six", "seven\u00a0still"], [], []]


def test_unfinished_fit_is_reported(spark):
    frame = spark.createDataFrame([(1, 100, 0.51, 0.49), (2, 100, 0.49, 0.51)], "id long, tokens long, p_0 double, p_1 double")
    mix = mixing.Mix(["a", "b"], [], [])
    with pytest.warns(UserWarning, match="after 5 steps miss a target"):
        mixing.fit_rates(frame, mix, {"a": 0.9, "b": 0.1}, steps=5)
    assert mix.totals["error"] > 0.1


def test_mixing_meets_targets(docs, labels):
    rates, mix = mixing.mixing_rates(docs, mixing.label_domains(labels), {"clean": 0.9, "poor": 0.07, "toxic": 0.03}, 1.25)
    row = rates.agg(F.sum("tokens").alias("n"), *[F.sum(F.expr(f"rate * tokens * p_{d}")).alias(d) for d in mix.domains]).first()
    assert all(abs(row[d] / row["n"] - w) < 0.01 for d, w in {"clean": 1.125, "poor": 0.0875, "toxic": 0.0375}.items())
    assert rates.where("rate < 0 or copies < floor(rate) or copies > floor(rate) + 1").count() == 0


def test_mixing_edges(spark, edge, labels):
    domains = mixing.label_domains(labels)
    rows = mixing.mixing_rates(edge, domains, {"clean": 1.0})[0].collect()
    assert len(rows) == len(EDGE)
    none = mixing.label_domains(spark.createDataFrame([], NO_LABELS))
    assert {r["rate"] for r in mixing.mixing_rates(edge, none, {"clean": 1.0})[0].collect()} == {1.0}
    mixed = mixing.mix_documents(edge, none, {"clean": 1.0})
    assert mixed.columns == edge.columns and mixed.count() == len(EDGE)
    assert mixing.mixing_rates(edge.limit(0), domains, {"clean": 1.0})[0].collect() == []
    assert mixing.mix_documents(edge.limit(0), domains, {"clean": 1.0}).collect() == []


def test_mixing_is_native(docs, labels):
    plan = mixing.mix_documents(docs, mixing.label_domains(labels), {"clean": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_broadcasts_have_a_bound():
    import pathlib

    root = pathlib.Path(mixing.__file__).parent
    used = {p.name: p.read_text().count("F.broadcast(") for p in root.glob("*.py") if "F.broadcast(" in p.read_text()}
    # a bit map has at most 8,192 rows of 4 KB; the language sample is 2 * MAX_SAMPLE ids; the sample is cut to 2 * per_class * classes rows of an id and a label;
    # a sort has a row of two numbers for each task; shards have a row for each cut, and one for each task and shard
    assert used == {"exact_dedup.py": 1, "common.py": 2, "hilbert.py": 2, "langid.py": 1}
    assert not any("localCheckpoint" in p.read_text() or "crossJoin" in p.read_text() for p in root.glob("*.py"))
