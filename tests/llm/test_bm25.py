"""Scores of the decontamination index against the BM25 formula, written out."""

import math
import random
from collections import Counter

from sheetwise.llm import decontaminate


def test_scores_are_bm25_over_the_item_itself(spark):
    rnd = random.Random(9)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.randint(18, 60)))) for k in range(40)]
    docs = [(k, " ".join(rnd.sample(items[k % 40][1].split(), 15) + rnd.choices(vocabulary, k=rnd.randint(0, 3)))) for k in range(60)]
    frequency = Counter(t for _, text in items for t in set(text.split()))
    mean = sum(len(text.split()) for _, text in items) / len(items)

    def bm25(query, text):
        counts, total = Counter(text.split()), 0.0
        for t in set(query.split()):
            idf = math.log(1 + (len(items) - frequency[t] + 0.5) / (frequency[t] + 0.5))
            total += idf * counts[t] * 2.2 / (counts[t] + 1.2 * (0.25 + 0.75 * len(text.split()) / mean))
        return total

    want = {(d, i): bm25(query, text) / bm25(text, text) for d, query in docs for i, text in items}  # documents fit into one passage
    frames = [spark.createDataFrame(rows, f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.retrieve(*frames, threshold=0.3).collect()}
    assert set(got) == {k for k, v in want.items() if v >= 0.3} and len(got) > 60
    assert all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def test_postings_pivots_and_blocks_lose_nothing():
    rnd = random.Random(4)
    common, rare = [f"c{k}" for k in range(12)], [f"r{k}" for k in range(400)]
    items = []
    for k in range(150):
        terms = rnd.choices(common, k=rnd.randint(1, 8)) + rnd.choices(rare, k=rnd.randint(0, 12))
        items.append((k, terms, terms, []))
    frequency = Counter(t for _, terms, *_ in items for t in set(terms))
    vocabulary, indexes = decontaminate.build(items, frequency, len(items), 12.0)
    texts = ["", None, " ".join(common)] + [" ".join(rnd.choices(common + ["other"], k=rnd.randint(0, 60)) + rnd.choice(items)[1]) for _ in range(80)]
    texts.append(" ".join(rnd.choices(common + rare, k=4000)))  # many cells
    for threshold in (0.15, 0.5, 0.95):
        want = {}
        for d, text in enumerate(texts):
            terms = decontaminate.terms_of(text)
            for index in indexes:
                for a in range(0, len(terms), index.cell):
                    held = {int(index.row[vocabulary[t]]) for t in terms[a : a + 2 * index.cell] if t in vocabulary}
                    for item, w in zip(index.items, index.weights):
                        s = sum(x for t, x in w.items() if t in held)
                        if s >= threshold - 1e-9:
                            want[d, item] = max(s, want.get((d, item), 0))
        found = {(d, i): s for d, i, s, *_ in decontaminate._find(indexes, vocabulary, texts, threshold)}
        assert set(found) <= set(want) and all(s < threshold + 1e-9 for k, s in want.items() if k not in found)
        assert len(found) > 50


def test_passages_of_common_words_open_no_block():
    items = [(k, ["the", "of", *(f"r{k}x{j}" for j in range(6))], [], []) for k in range(64)]
    frequency = Counter(t for _, terms, *_ in items for t in terms)
    vocabulary, (index,) = decontaminate.build(items, frequency, len(items), 8.0)
    scored = []
    index._scores = lambda spots, *_: scored.append(len(spots)) or []
    assert not list(decontaminate._find([index], vocabulary, ["the of " * 500] * 20, 0.5)) and not scored
    list(decontaminate._find([index], vocabulary, ["the of " * 500 + " ".join(items[9][1]) + " of the" * 500], 0.5))
    assert sum(scored) <= 2  # of 64 items and over a hundred passages
