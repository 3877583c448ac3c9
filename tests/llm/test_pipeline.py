"""Each stage of the pipeline against brute force on its own input, then the whole run."""

from collections import Counter, defaultdict

import corpus_pipeline
from sheetwise.llm import decontaminate, language_id, line_dedup, mixing
from sheetwise.llm.common import keep
from tests.llm import brute
from tests.llm.test_near_copies import groups

SF = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def lines(plain):
    pages, held = Counter(), Counter()
    trim = lambda x: x.strip(" \t\r")
    for _, text, _, source, _ in plain:
        pages[source] += 1
        for x in {trim(x) for x in text.split("\n")} - {""}:
            held[source, x] += 1
    common = {k for k, n in held.items() if n >= line_dedup.MIN_PAGES and n > line_dedup.MAX_RATIO * pages[k[0]]}
    out = []
    for d, text, lang, source, n in plain:
        kept = "\n".join(x for x in text.split("\n") if (source, trim(x)) not in common)
        out.append((d, kept, lang, source, n if kept == text else len(kept)))
    return out


def leaks(plain, items):
    gone = set()
    terms = {k: decontaminate.terms_of(t) for k, t in items}
    for d, text, *_ in plain:
        words = decontaminate.terms_of(text)
        held = set(zip(*(words[k:] for k in range(5))))
        for t in terms.values():
            own = set(zip(*(t[j:] for j in range(5))))
            if sum(x in held for x in own) >= 0.8 * len(own):
                gone.add(d)
    return gone


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows(docs)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = language_id.fit(docs)
    known = {r.doc_id for r in language_id.identify(docs, model).where("lang_pred <> 'und' and score >= 0.5").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, SF), "test-stage")
        if name == "mixing":
            assert out.columns == [*docs.columns, "copy_no"]
            size, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
            for _, text, _, source, _ in before:
                n = len(brute.WORD.findall(text))
                size[source] += n
                largest[source] = max(n, largest[source])
            for _, text, _, source, _ in rows(out):
                taken[source] += len(brute.WORD.findall(text))
            for s, t in brute.targets(size, mixing.WEIGHTS).items():
                assert abs(taken[s] - t) <= largest[s] + 1e-3 * t
            assert max(Counter(r[0] for r in rows(out)).values()) <= mixing.MAX_COPIES
            break
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language_id":
            want = [r for r in before if r[0] in known]
        elif name == "line_dedup":
            want = lines(before)
        elif name == "near_dedup":
            # Five words and a similarity of 0.8, as for all stages on shingles.
            first = {min(before[i][0] for i in g) for g in groups([r[:2] for r in before])}
            want = [r for r in before if r[0] in first]
        else:
            gone = leaks(before, items)
            want = [r for r in before if r[0] not in gone]
        after = rows(out)
        assert sorted(after) == sorted(want), name
        docs, before = out, after


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy_no"]
    assert out.count() > 0 and out.where("copy_no > 3").count() == 0


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF), "test-empty")
        assert docs.count() == 0
