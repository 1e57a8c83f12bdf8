"""The two classifiers against plain Python that shares none of their code."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import toxicity, url_filter
from tidemark.llm.durable import table

MASK = (1 << 64) - 1


def plain_ngrams(text: str, sizes: tuple[int, ...], bits: int, seed: int = 0) -> set[int]:
    """Hashes of n-grams, one character after another, in whole numbers."""
    out = set()
    for n in sizes:
        for k in range(len(text) - n + 1):
            state = 0
            for c in text[k : k + n]:
                state = (state * 0xD6E8FEB86659FD93 + (ord(c) + 1 + seed) * 0x9E3779B97F4A7C15) & MASK
            out.add((((state ^ (state >> 29)) * 0x9E3779B97F4A7C15) & MASK) >> (64 - bits))
    return out


def logistic(margin: float) -> float:
    return 1 / (1 + math.exp(-margin))


def test_toxicity_model_by_definition(spark):
    """Features, log-count ratios and the optimum of the penalised loss, all worked out anew; and the scores that follow."""
    rng = random.Random(6)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randrange(3, 7)))
    clean, foul = [word("abcdefgh") for _ in range(60)], [word("stuvwxyz") for _ in range(12)]  # words recur, as in any language
    docs = {k: " ".join(rng.choice(clean if rng.random() < 0.95 else foul) for _ in range(12)) for k in range(120)}
    labels = {k: int(k % 3 == 0) for k in docs}
    for k, y in labels.items():
        if y:
            docs[k] += " " + " ".join(rng.choice(foul) for _ in range(4))
    config = toxicity.ToxicityConfig(bits=14)
    taught = {k for k in docs if zlib.crc32(str(k).encode()) % 5 != 0}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    known = spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model = toxicity.train(frame, known, config)

    grams = {k: plain_ngrams(docs[k].lower(), config.sizes, config.bits) for k in docs}
    inside, outside = np.zeros(1 << 14), np.zeros(1 << 14)
    for k in taught:
        for g in grams[k]:
            (inside if labels[k] else outside)[g] += 1
    p, q = inside + 1, outside + 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    ratio[(inside + outside < config.min_rows) | (np.abs(ratio) < config.min_ratio)] = 0
    used = np.flatnonzero(ratio)
    assert set(np.flatnonzero(model.weights)) <= set(used.tolist())
    w = model.weights[used].astype(float) / ratio[used]  # the weights of the scaled features
    margins = {k: sum(float(model.weights[g]) for g in grams[k]) + model.intercept for k in docs}
    gradient = config.l2 * w
    place = {g: i for i, g in enumerate(used.tolist())}
    for k in taught:
        error = logistic(margins[k]) - labels[k]
        for g in grams[k]:
            if g in place:
                gradient[place[g]] += error * ratio[g]
    assert np.abs(gradient).max() < 1e-2  # the least loss
    found = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    for k in docs:
        assert found[k].held_out == (k not in taught)
        assert abs(found[k].score - logistic(margins[k])) < 1e-4
        assert found[k].predicted == int(found[k].score >= 0.5)
    assert np.mean([found[k].predicted == labels[k] for k in docs if k not in taught]) >= 0.9


def test_toxicity_ranks_held_out_documents(spark):
    """Area under the curve on held-out labelled rows."""
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = toxicity.toxicity(table(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out").select("score", "toxic").collect()
    good, bad = [r.score for r in rows if r.toxic == 0], [r.score for r in rows if r.toxic == 1]
    assert len(bad) >= 3
    assert np.mean([(b > g) + 0.5 * (b == g) for b in bad for g in good]) >= 0.85


def plain_judgement(url: str | None) -> tuple[str, str, str | None, str | None]:
    """Host, path, rule and the rule's verdict, letter by letter."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        while rest and rest[0] not in "/?#":
            host += chr(ord(rest[0]) + 32) if "A" <= rest[0] <= "Z" else rest[0]
            rest = rest[1:]
        while rest and rest[0] not in "?#":
            path += rest[0]
            rest = rest[1:]
    best = None
    for verdict, rule in (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")):
        name, rest = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    return (host, path, best[1], best[0]) if best else (host, path, None, None)


def test_url_judgements_by_definition(spark):
    """Rules by the letter, and the classifier's margin from n-grams worked out anew; long, repeated and odd urls too."""
    rng = random.Random(3)
    hosts = ["example.com", "www.example.com", "WWW.Example.COM", "aexample.com", "x.net", "net", "com", "a.org", "", "spam-farm.example.org", "é.net"]
    paths = ["", "/", "/en", "/en/", "/en/x", "/es/", "/fr/a?b", "#/en/", "?x=/en/", "/EN/", "/fr/" + "y" * 200_000]
    urls = [f"{rng.choice(['http', 'https', 'ftp', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(150)]
    urls += ["no scheme", "", None, "a://b://c/d", "://", urls[0], urls[0]]
    rows = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string")
    weights, intercept = url_filter.train()
    found = sorted(url_filter.judge_urls(rows).collect(), key=lambda r: r.page_id)
    assert len(found) == len(urls)
    for r, u in zip(found, urls, strict=True):
        host, path, rule, verdict = plain_judgement(u)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if len(path) < 1000:
            ids = plain_ngrams(f"^{host}$", (3, 4, 5), 14, 1) | {(1 << 14) + g for g in plain_ngrams(f"^{path}$", (3, 4, 5), 14, 2)}
            assert abs(r.block_score - logistic(sum(float(weights[g]) for g in ids) + intercept)) < 1e-9
        assert r.verdict == (verdict or ("block" if r.block_score >= 0.5 else "allow"))


def test_url_classifier_on_hosts_that_it_has_not_seen():
    """Each labelled URL judged by a model that has learnt from no URL of its host's own name."""
    labelled = [(u, 1) for u in url_filter.BLOCKED_URLS] + [(u, 0) for u in url_filter.ALLOWED_URLS]

    def name(url: str) -> str:
        host = url_filter.split_url(url)[0].removeprefix("www.").removeprefix("m.").removeprefix("blog.")
        return host.split(".")[0]

    right = 0
    for url, y in labelled:
        blocked = [u for u, z in labelled if z == 1 and name(u) != name(url)]
        allowed = [u for u, z in labelled if z == 0 and name(u) != name(url)]
        weights, intercept = url_filter.train(blocked, allowed)
        margin = float(weights[url_filter.url_features(*url_filter.split_url(url))].sum()) + intercept
        right += (margin >= 0) == (y == 1)
    assert right / len(labelled) >= 0.6


def test_url_empty_table(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string").withColumn("host", F.lit("x"))).count() == 0
