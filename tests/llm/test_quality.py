import random
import re
from pathlib import Path

import numpy as np
import pytest

from caselink.llm import quality

DATA = Path("/root/testdata/sf0.01")


def test_em_finds_the_accuracy_of_labellers():
    rng = np.random.default_rng(2)
    good = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.75, 0.6, 0.85, 0.9, 0.7, 0.8])
    votes = np.where(rng.random((20_000, 8)) < right, np.where(good[:, None], quality.HIGH, quality.LOW), np.where(good[:, None], quality.LOW, quality.HIGH))
    votes[rng.random(votes.shape) < 0.3] = quality.ABSTAIN
    patterns, counts = np.unique(votes @ quality._POWERS, return_counts=True)
    posterior, prior, found = quality.fit_labels(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.02 and np.abs(found - right).max() < 0.03
    where = np.searchsorted(patterns, votes @ quality._POWERS)
    assert ((posterior[where] > 0.5) == good).mean() > 0.95


def test_votes_round_trip():
    votes = np.random.default_rng(0).integers(0, 3, (50, len(quality.LABELLERS)))
    assert (quality.unpack(votes @ quality._POWERS) == votes).all()


def test_em_of_a_corpus_that_is_mostly_junk():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.15
    votes = np.where(rng.random((20_000, 8)) < 0.85, np.where(good[:, None], quality.HIGH, quality.LOW), np.where(good[:, None], quality.LOW, quality.HIGH))
    patterns, counts = np.unique(votes @ quality._POWERS, return_counts=True)
    posterior, prior, _ = quality.fit_labels(patterns, counts.astype(float))
    assert abs(prior - 0.15) < 0.02
    assert ((posterior_at(posterior, patterns, votes) > 0.5) == good).mean() > 0.98


def posterior_at(posterior, patterns, votes):
    return quality.posterior_of(votes @ quality._POWERS, patterns, posterior)


# A second way to all figures, in plain Python on strings and lists.


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    low = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words]
    n, some = len(words), max(1, len(words))
    again = [i > 0 and low[i] == low[i - 1] for i in range(n)]
    stop = set(quality.STOP_WORDS.split())
    raw = text.encode()
    upper, lower = (sum(a <= b <= z for b in raw) for a, z in ((65, 90), (97, 122)))
    other = sum(b >= 0xC4 for b in raw)
    return {
        "words": n, "symbol": sum(c in "#$%&*<>{}[]^~\\=" for c in text) / some, "bar": text.count("|") / some, "mark": sum(c in "!?" for c in text) / some,
        "upper": upper / max(1, upper + lower), "again": sum(again) / some, "distinct": len(set(low)) / some, "stop": sum(w in stop and not r for w, r in zip(low, again)) / some,
        "length": sum(len(w.encode()) for w in words) / some, "foreign": other / max(1, upper + lower + other),
    }


def plain_votes(found):
    out = []
    for labeller, (name, least, low, high) in quality.LABELLERS.items():
        vote = quality.ABSTAIN
        if found["words"] >= least and not (labeller in quality.LATIN_ONLY and found["foreign"] > quality.FOREIGN):
            for verdict, rule in ((quality.HIGH, high), (quality.LOW, low)):
                if rule and (found[name] > rule[1] if rule[0] == ">" else found[name] < rule[1]):
                    vote = verdict
        out.append(vote)
    return out


def plain_em(votes, rounds=200):
    right, prior = [0.8] * len(quality.LABELLERS), 0.7
    for _ in range(rounds):
        good = []
        for v in votes:
            odds = prior / (1 - prior)
            for x, r in zip(v, right):
                odds *= {quality.HIGH: r / (1 - r), quality.LOW: (1 - r) / r}.get(x, 1)
            good.append(odds / (1 + odds))
        prior = min(0.999, max(0.001, sum(good) / len(good)))
        for j in range(len(right)):
            cast = [(v[j], g) for v, g in zip(votes, good) if v[j] != quality.ABSTAIN]
            agree = sum(g if x == quality.HIGH else 1 - g for x, g in cast) + 4
            right[j] = min(0.99, max(0.55, agree / (len(cast) + 5)))
    return good, prior, right


def plain_score(text, weights):
    raw, words = text.encode(), plain_statistics(text)["words"]
    if not words:
        return 0.0
    total = weights[-1]
    grams = [((raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(len(raw) - 2)]
    total += sum(weights[g] for g in grams) / max(1, len(grams))
    kind = lambda b: 3 if b > 127 else next((k for k, f in ((0, str.islower), (1, str.isupper), (2, str.isdigit)) if f(chr(b))), 4 if chr(b) in ".,;:" else 5 if chr(b) in "!?" else 6 if chr(b) == "|" else 7)
    found = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    events = [(i > 0 and found[i].lower() == found[i - 1].lower()) * 128 + kind(w[0]) * 32 + kind(w[-1]) * 4 + min(len(w) // 4, 3) for i, w in enumerate(found)]
    total += sum(weights[quality.TRIGRAMS + e] for e in events) / len(events)
    return 1 / (1 + np.exp(-total))


def texts_of(seed, n=160):
    rng = random.Random(seed)
    plain, junk = quality.STOP_WORDS.split() + ["house", "river", "Light", "été", "garden,"], ["$$$", "BUY", "now!!!", "|", "spam", "spam", "x" * 20, "{}", "слово", "中文字"]
    out = ["", " \n", "a", "one two three", "слово " * 30, "中文 " * 25]
    for _ in range(n):
        words = [rng.choice(junk if rng.random() < (share := rng.choice((0, 0, 0.1, 0.6, 1))) else plain) for _ in range(rng.randrange(1, 120))]
        out.append(rng.choice((" ", "  ", "\n")).join(words) + rng.choice(("", ".", " ")))
    return out


def test_whole_query_equals_plain_python(spark):
    """Statistics, votes, EM and scores of every document, by a second way; the weights are taken as fitted."""
    texts = texts_of(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [plain_statistics(t) for t in texts]
    for i, text in enumerate(texts):
        data = np.frombuffer(text.encode(), np.uint8)
        got = quality.statistics(data, np.array([0, len(data)]), quality.words_of(data, np.array([0, len(data)])))
        assert {k: round(float(v[0]), 9) for k, v in got.items()} == {k: round(float(v), 9) for k, v in found[i].items()}, text
        assert quality.vote(got)[0].tolist() == plain_votes(found[i])
    some = [i for i, f in enumerate(found) if f["words"]]
    good, _, _ = plain_em([plain_votes(found[i]) for i in some])
    patterns, posterior, weights = quality._model(df, 100, "text")
    rows = {r["doc_id"]: r for r in quality.classify(df, sample=100).collect()}
    assert np.abs(weights).max() > 0 and len(rows) == len(texts)
    for i, g in zip(some, good):
        assert abs(rows[i]["posterior"] - g) < 1e-6
        assert abs(rows[i]["score"] - plain_score(texts[i], weights)) < 1e-6 and rows[i]["keep"] == (rows[i]["score"] >= 0.5)
    assert all(rows[i]["score"] == 0 and rows[i]["posterior"] is None and not rows[i]["keep"] for i in range(len(texts)) if i not in some)


def test_words_of_other_scripts_are_not_judged_by_latin_ones():
    found = plain_statistics("слово за слово и ещё одно слово " * 10)
    at = list(quality.LABELLERS).index("stop_words")
    assert plain_votes(found)[at] == quality.ABSTAIN and plain_votes(plain_statistics("blah blih bloh " * 10))[at] == quality.LOW


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_labelled_documents(spark):
    """Held-out labels: no clean document is rejected, most of the others are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = quality.classify(docs).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    clean, junk = [r for r in found if r["quality"] == 1], [r for r in found if r["quality"] == 0]
    assert sum(not r["keep"] for r in clean) <= 0.01 * len(clean)
    assert sum(not r["keep"] for r in junk) >= 0.8 * len(junk)
    agree = sum((r["posterior"] > 0.5) == (r["quality"] == 1) for r in found)
    assert agree / len(found) > 0.97


def test_defined_cases(messy, nothing):
    rows = quality.classify(messy).collect()
    assert len(rows) == messy.count()
    assert all(r["score"] == 0 and not r["keep"] and r["posterior"] is None for r in rows if r["doc_id"] in (3, 4, 5))
    assert quality.classify(nothing).count() == 0
    kept = quality.drop_low_quality(messy)
    assert kept.columns == messy.columns
    assert {3, 4, 5}.isdisjoint({r["doc_id"] for r in kept.collect()})


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_rows_that_share_an_id_are_dropped_one_by_one(spark):
    """A third of the rows without an id, a third with the same one."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.selectExpr("case doc_id % 3 when 0 then null when 1 then 1 else doc_id end as doc_id", "text").where("doc_id is null or doc_id % 6 > 0")
    count = lambda rows: {k: rows.count(k) for k in (None, 1)}
    rows, kept = [r[0] for r in docs.select("doc_id").collect()], [r[0] for r in quality.drop_low_quality(docs).select("doc_id").collect()]
    want = [r["doc_id"] for r in quality.classify(docs).where("keep").collect()]
    assert count(kept) == count(want) and len(kept) == len(want)
    assert all(0 < count(kept)[k] < count(rows)[k] for k in (None, 1))
