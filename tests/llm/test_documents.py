"""Packing, mixing and subject areas."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import mixing
from corvane.llm.mixing import distribution, fitted, mix, plan, share_report
from corvane.llm.packing import attention, best_fit, fill_report, pack
from corvane.llm.subjects import DEFAULT, Weights, assign_subjects, learn, sections, subject_shares
from corvane.llm.tokens import token_counts

SCHEMA = "doc_id long, text string, source string, repo string, doc string, tokens string, block int, container string, subject string, u double, h long, total int"
PATH = "/opt/tokenizers/byte_bpe_50k.json"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "d", "t", 1, "c", "s", 0.5, 3, 4) for r in rows], SCHEMA)


def some(n, seed=1, source=lambda r: r.choice(["big"] * 12 + ["mid"] * 4 + ["small"])):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(["alpha", "ledger", "grid", "orbit"]) for _ in range(int(r.lognormvariate(3.3, 1)))), source(r), None) for i in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_keeps_every_constraint(seed):
    rng = np.random.default_rng(seed)
    tokens = rng.integers(0, 1000, size=400)
    most = float(attention(1000)) * (0.6 if seed % 2 else 1.0)
    tokens = tokens[attention(tokens) <= most]
    slots = best_fit(tokens, 1000, 6, most)
    for s in np.unique(slots):
        own = tokens[slots == s]
        assert own.sum() <= 1000 and len(own) <= 6 and attention(own).sum() <= most
    if seed % 2 == 0:
        assert len(np.unique(slots)) <= 1.1 * max(math.ceil(tokens.sum() / 1000), math.ceil(len(tokens) / 6))


@pytest.mark.parametrize(
    ("tokens", "caps", "want"),
    [([600, 500], (1000, 9, 1e9), 2), ([600, 400], (1000, 9, 1e9), 1), ([10] * 9, (1000, 4, 1e9), 3), ([10] * 9, (1000, 9, 1e9), 1), ([10] * 9, (1000, 9, 4 * 16**2), 3), ([512, 200], (1000, 9, 512**2), 2), ([512, 200], (1000, 9, 512**2 + 208**2), 1)],
)
def test_each_capacity_refuses_a_container(tokens, caps, want):
    assert len(set(best_fit(np.array(tokens), *caps).tolist())) == want


def test_packing_is_whole(spark):
    rows = [*some(300), (900, "word " * 3000, "big", None), (901, "", "big", None), (902, None, "big", None), (None, "text", "big", None), (5, None, "big", None)]
    df = docs(spark, rows + rows[:20])
    out = pack(df, 256).collect()
    want = {r[0]: n for r, n in zip([r for r in rows if r[0] is not None and r[1] is not None], token_counts([r[1] for r in rows if r[0] is not None and r[1] is not None], PATH), strict=True)}
    got, fill = defaultdict(list), Counter()
    for r in out:
        got[r.doc].append((r.first_token, r.tokens))
        fill[r.container] += r.tokens
    assert max(fill.values()) <= 256 and got.keys() == want.keys()
    for d, p in got.items():
        assert sum(t for _, t in p) == want[d] and [a for a, _ in sorted(p)] == list(range(0, max(1, want[d]), 256))
        assert len(p) == max(1, -(-want[d] // 256))
    report = fill_report(pack(df, 256), 256).first()
    assert report.fill > 0.95 and report.tokens == sum(want.values())
    assert pack(df.limit(0), 256).count() == 0


@pytest.mark.parametrize(("rate", "cap"), [(0.3, 1), (1.7, 2), (4.0, 4), (0.0, 3), (40.0, 60), (800.0, 1000), (5000.0, 4990)])
def test_poisson(rate, cap):
    steps = distribution(rate, cap)
    want = [sum(math.exp(-rate + j * math.log(rate) - math.lgamma(j + 1)) for j in range(k + 1)) if rate else 1.0 for k in (0, cap // 2, cap - 1)]
    assert len(steps) == cap and np.allclose([steps[0], steps[cap // 2], steps[-1]], want, atol=1e-6)
    uses = mixing.times(rate, cap)
    assert uses.max(initial=0) <= cap and abs(uses.mean() - sum(1 - steps)) < 0.01 * max(1, rate) + 0.01


@pytest.mark.parametrize(("rate", "cap"), [(0.2, 1), (0.97, 1), (1.5, 3), (700.0, 1000), (999.0, 1000)])
def test_copies_come_to_the_share(rate, cap):
    rng = np.random.default_rng(cap)
    tokens = np.zeros(mixing.BINS)
    np.add.at(tokens, rng.integers(0, mixing.BINS, 3000), rng.integers(1, 200, 3000))
    got = tokens @ fitted(tokens, rate * tokens.sum(), cap)
    assert abs(got - rate * tokens.sum()) <= tokens.max()
    assert tokens @ fitted(tokens, cap * tokens.sum() + 1, cap) == cap * tokens.sum()


def test_plan():
    rates = plan([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2)], {"a": 1000, "b": 100})
    assert rates == {"a": (550.0, 1, False), "b": (pytest.approx(330.0), 4, False), "c": (0, 2, True)}
    assert plan([("a", 1.0, 1)], {}) == {"a": (0.0, 1, True)} and plan([("a", 0.9, 1), ("b", 0.1, 1)], {"a": 50, "b": 50})["a"] == (50, 1, True)


def test_mix(spark):
    rows = [*some(3000, 2), (9000, "stray", "elsewhere", None), (9001, "stray", None, None), (9002, None, "big", None), (9003, "", "big", None)]
    df = docs(spark, rows + rows[:50])
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.15, 2), ("absent", 0.05, 3)], "source string, target_share double, max_repeats int")
    out = mix(df, targets).collect()
    uses, cap = Counter((r.doc, r.source) for r in out), {"big": 1, "mid": 2, "small": 2}
    assert all(n <= cap[s] for (_, s), n in uses.items()) and len(out) == len({(r.doc, r.copy) for r in out})
    assert {d for d, _ in uses}.isdisjoint({9000, 9001, 9002, 9003})
    keys = [r.shuffle_key for r in out]
    assert keys == sorted(keys)
    report = {r.source: r for r in share_report(df, targets).collect()}
    for s in ("big", "mid"):
        assert abs(report[s].used_tokens / report[s].wanted_tokens - 1) < 0.01 and not report[s].short
    # every record of the small source at its cap is not enough
    assert report["small"].short and report["small"].used_tokens == 2 * report["small"].available_tokens
    assert report["absent"].short and report["absent"].used_tokens == 0
    assert sum(r.used_tokens for r in report.values()) == sum(r.tokens for r in out) and abs(sum(r.share_reached for r in report.values()) - 1) < 1e-9
    assert [tuple(r) for r in mix(df, targets).collect()] == [tuple(r) for r in out]
    assert mix(df.limit(0), targets).count() == 0 and share_report(df.limit(0), targets).count() == 4
    less = {r.source: r for r in share_report(df, targets, total=2000.0).collect()}
    assert not any(r.short for s, r in less.items() if s != "absent") and all(abs(less[s].share_reached - w / 0.95) < 0.06 for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.15)))
    # counts of single records are those of a Poisson distribution, not of a running sum
    big = [uses.get((r[0], "big"), 0) for r in rows if r[2] == "big" and r[1]]
    assert 0.3 < sum(big) / len(big) < 0.9


LAW = "The tribunal asked the plaintiff for a witness statement."
SKY = "The telescope missed the comet near the nebula."
CHAT = "Thanks for the quick answer."
IDIOM = "Bear with me, the train of thought was lost."


def test_sentences():
    text = f"# Heading here\n\n{LAW} {CHAT}\n\n```\ncode = parse(x)\n```\n<details><summary>log</summary>0a0e 0f0e\n</details>\nuser: {SKY}\n- {CHAT}\n--\n"
    assert [x for s in sections(text) for x in s] == [LAW, CHAT, SKY, CHAT]
    votes = Weights(DEFAULT, {}).votes
    assert votes(LAW)[0] and votes(SKY)[0] and not votes(CHAT)[0] and not votes(IDIOM)[0]


def test_subjects(spark):
    rows = [(i, " ".join([LAW] * 2 + [CHAT] * 2), "issues", "r1") for i in range(30)] + [(100 + i, " ".join([SKY] + [CHAT] * 3), "issues", "r2") for i in range(30)]
    rows += [(200 + i, " ".join([CHAT] * 3 + [IDIOM]), "adrs", "r3") for i in range(30)] + [(300, " ".join([SKY] + [CHAT] * 9), "issues", None), (301, f"{LAW} {SKY}", None, None), (302, "", "x", "r"), (303, None, "x", "r"), (None, LAW, "x", "r"), (304, "# Only a heading", "x", "r")]
    rows += [(305, " ".join([LAW, CHAT, CHAT, CHAT] * 3000), "issues", "r1")]
    df = docs(spark, rows + rows[:5])
    got = defaultdict(set)
    for r in assign_subjects(df).collect():
        got[r.doc].add(r.subject)
    assert all(got[i] == {"law"} for i in range(30)) and all(got[100 + i] == {"astronomy"} for i in range(30))
    assert not any(got.get(200 + i) for i in range(30)) and not got.get(300) and got[301] == {"law", "astronomy"} and got[305] == {"law"}
    assert got.keys().isdisjoint({302, 303, 304, None})
    shares = {r.subject: r.documents for r in subject_shares(df).collect()}
    assert shares == {"law": 32, "astronomy": 31}
    assert assign_subjects(df.limit(0)).count() == 0


def test_em_tells_functions_apart():
    rng = random.Random(3)
    patterns = Counter()
    for _ in range(20000):
        y = rng.random() < 0.2
        a = (2 if rng.random() < 0.9 else 0) if y else (1 if rng.random() < 0.1 else 0)
        b = (2 if rng.random() < 0.7 else 0) if y else (2 if rng.random() < 0.05 else 0)
        patterns[a, b] += 1
    post = learn({k: float(v) for k, v in patterns.items()}, [3, 3])
    assert post[2, 2] > 0.95 and post[0, 0] < 0.1 and post[1, 0] < 0.1


def test_the_stated_share_is_kept(spark):
    """A document short of a quarter, though within two hundredths of it, has no subject; one of just a quarter has."""
    rows = [(i, " ".join([LAW] * 2 + [CHAT] * 2), "issues", "r1") for i in range(30)]
    rows += [(100, " ".join([LAW] * 12 + [CHAT] * 38), "issues", "r1"), (101, " ".join([LAW] * 12 + [CHAT] * 36), "issues", "r1")]
    got = {r.doc for r in assign_subjects(docs(spark, rows)).collect()}
    assert got == {*range(30), 101}


COOK = "Simmer the broth while the dough is rising."
NEW = "The blorpine was filed with the kelvator on Friday."


def test_terms_that_no_list_holds_are_learned(spark):
    """Words that stand beside seeds of a subject come to speak for it; words that stand everywhere don't, nor do seeds in them."""
    rows = [(i, f"{LAW} {NEW} {CHAT} {IDIOM}", "issues", f"r{i % 7}") for i in range(60)]
    rows += [(100 + i, f"{SKY} {SKY} {CHAT} {IDIOM}", "issues", f"s{i % 7}") for i in range(60)]
    rows += [(200 + i, f"Passengers at the airport missed the ferry. {CHAT} {IDIOM}", "adrs", f"t{i % 7}") for i in range(60)]
    rows += [(300, f"{NEW} {NEW}", "mail", None), (301, f"{CHAT} {IDIOM}", "mail", None)]
    got = defaultdict(set)
    for r in assign_subjects(docs(spark, rows)).collect():
        got[r.doc].add(r.subject)
    assert got[300] == {"law"} and not got.get(301)
    assert all(got[i] == {"law"} and got[100 + i] == {"astronomy"} and got[200 + i] == {"transport"} for i in range(60))


def test_ordinary_words_of_each_subject(spark):
    texts = {
        "law": "The magistrate granted an injunction.", "sport": "The quarterback threw a touchdown.", "music": "She plays the sonata on the piano.", "medicine": "Chemotherapy was stopped by the oncologist.", "astronomy": "The spacecraft flew past Neptune.",
        "finance": "The bank raised the dividend.", "agriculture": "The farmer sold his cattle.", "transport": "The railway moved the cargo.", "energy": "The photovoltaic generator failed.", "tooling": "The compiler rejects this syntax.",
    }
    rows = [(i, t, None, None) for i, t in enumerate(texts.values())]
    got = {r.doc: r.subject for r in assign_subjects(docs(spark, rows)).collect()}
    assert got == dict(enumerate(texts))


def test_subjects_come_from_their_table_and_labels_count(spark):
    table = spark.createDataFrame([("cooking", "food: broth, dough and recipes"), ("law", "legal matters"), (None, "x")], "subject string, description string")
    rows = [(i, f"{COOK} {CHAT}", "issues", None) for i in range(80)] + [(100 + i, f"{LAW} {CHAT}", "issues", None) for i in range(20)]
    rows += [(200 + i, f"{NEW} {CHAT}", "issues", None) for i in range(40)]
    got = {(r.doc, r.subject) for r in assign_subjects(docs(spark, rows), subjects=table).collect()}
    assert got == {(i, "cooking") for i in range(80)} | {(100 + i, "law") for i in range(20)}
    labels = spark.createDataFrame([(200 + i, "law") for i in range(30)] + [(201, "none"), (None, "law")], "doc_id long, subject string")
    rated = {r.doc for r in assign_subjects(docs(spark, rows), subjects=table, labels=labels).where("subject = 'law'").collect()}
    assert rated == {100 + i for i in range(20)} | {200 + i for i in range(40)}
    assert assign_subjects(docs(spark, rows), subjects=table.limit(0)).count() == 0


def test_sentences_in_unknown_words_go_with_their_section_and_repository(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("bcdfgklmnprstvz", k=3)) + "".join(rng.choices("aeiou", k=2)) + "".join(rng.choices("bcdfgklmnprstvz", k=3))
    odd = lambda: " ".join(word() for _ in range(6)).capitalize() + "."
    rows = [(i, " ".join([LAW] * 4 + [CHAT] * 2), "issues", f"r{i % 3}") for i in range(60)] + [(100 + i, " ".join([SKY] * 4 + [CHAT] * 2), "issues", f"s{i % 3}") for i in range(60)]
    rows += [(300, " ".join([LAW] * 3 + [odd() for _ in range(3)] + [CHAT] * 7), "issues", "r1"), (301, " ".join([LAW] * 3 + [CHAT] * 10), "issues", "r1"), (302, odd(), "issues", None)]
    got = {r.doc: r.subject for r in assign_subjects(docs(spark, rows)).collect()}
    assert got.get(300) == "law" and 301 not in got and 302 not in got
