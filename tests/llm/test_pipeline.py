"""The pipeline against its stages done one row at a time, and odd inputs."""

import zlib
from collections import Counter, defaultdict

import public_tokenizers

import corpus_pipeline
from test_operators import plain_languages, plain_wide, squeezed, wide_linked
from tidewheel.llm import language, packing, quality, token_files
from tidewheel.llm.common import table

SF = "/root/testdata/sf0.001"


def brute(spark, rows, sf):
    """Documents that each stage leaves: (doc_id, text) in, four lists out."""
    taught = [(r["text"], r["lang"]) for r in table(spark, sf, "documents").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    _, judge = plain_languages(taught)
    weights = quality.quality_model(spark, sf)
    kept = [(i, t) for i, t in rows if judge(t)[2] >= language.LEAST_LIKENESS]
    out = [kept]
    features = quality.Featuriser()

    def good(t):
        at, x = features.features(t)
        return 1 / (1 + 2.718281828459045 ** -float(weights[at] @ x + weights[-1])) >= quality.THRESHOLD

    kept = [(i, t) for i, t in kept if good(t)]
    out.append(kept)
    groups = defaultdict(list)
    for i, t in kept:
        groups[squeezed(t)].append((-len(t or ""), i is None, i or 0, i, t))
    kept = [min(g)[3:] for g in groups.values()]
    out.append(kept)
    prints = {r: plain_wide(r[1]) for r in kept}
    roots, least = wide_linked(prints.values()), {}
    for (i, t), f in prints.items():
        if i is not None:
            least[roots[f]] = min(i, least.get(roots[f], i))
    ids = set(least.values())
    out.append([r for r in kept if r[0] in ids or (r[0] is None and roots[prints[r]] not in least)])
    return out


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute(spark, [(r["doc_id"], r["text"]) for r in docs.collect()], SF)
    for (name, step), rows in zip(corpus_pipeline.STAGES[:-1], want, strict=True):
        before, docs = docs.count(), step(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        found, rows = Counter((r["doc_id"], r["text"]) for r in docs.collect()), Counter(rows)
        if name == "near_dedup":  # by chance a pair may not meet: nothing else goes, and nine in ten of all that should go
            assert rows <= found and found.total() - rows.total() <= 0.1 * (before - rows.total()), name
        else:
            assert found == rows, name
    packed = corpus_pipeline.run(spark, SF).collect()
    counter = token_files.ChunkEncoder(public_tokenizers.path("word_bpe_49k.json"), 1)
    tokens = Counter()
    for r in packed:
        for p in r["parts"]:
            tokens[p["doc_id"]] += p["n"]
        assert r["bin_length"] in packing.LENGTHS
    assert tokens == {i: len(counter.encode([t])[0]) // 2 for i, t in found}


def test_stages_take_odd_rows(spark, messy, none):
    for given in (messy, none):
        docs = given
        for name, step in corpus_pipeline.STAGES[:-1]:
            out = step(spark, docs, SF)
            assert out.columns == docs.columns, name
            assert out.count() <= docs.count()
            docs = out
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (given is messy)
