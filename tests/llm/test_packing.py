import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

import tidewake.llm.packing as pk  # noqa: E402

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))
ODD = ["a\x1cb c", "½ x² Ⅷ", "<|endoftext|> hi", "  lead \n\n x\t\ty  ", "_foo__ bar_baz 12_3", "don't we'll 'S", "日本語 テキスト", "é̀ ñ", "👍🏽 ok", "", None]


def test_ids_are_those_of_the_tokenizer():
    whole, fast = Tokenizer.from_file(PATH), pk.encoder(PATH)
    assert fast.fast is not None
    for t in ODD:
        assert fast(t or "").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def brute_cost(ends, documents, total, limit):
    """Least cost over all cuts at ends of sentences or documents."""
    states = sorted({0, total, *(e for e in [*ends, *documents] if e < total)})
    best = {0: 0}
    for j in states[1:]:
        cost = pk.SEQUENCE_COST + (0 if j in documents or j == total else pk.DOCUMENT_COST)
        best[j] = min((best[i] + pk.waste(j - i, limit) + cost for i in states if i < j and j - i <= limit and i in best), default=1 << 40)
    return best[total]


def test_program_is_optimal_where_ends_are_dense(monkeypatch):
    monkeypatch.setattr(pk, "CUT_WITHIN", 10_000)
    monkeypatch.setattr(pk, "CLOSEST", 1)
    monkeypatch.setattr(pk, "_tail", lambda start, end, limit: [end])
    rng = np.random.default_rng(0)
    for _ in range(20):
        docs = np.cumsum(rng.integers(5, 60, 12))
        ends = np.unique(rng.integers(1, docs[-1], 25))
        cuts = pk.plan_cuts(ends, docs, int(docs[-1]), 64, True).tolist()
        assert cuts[-1] == docs[-1] and all(b - a <= 64 for a, b in zip([0, *cuts], cuts, strict=False))
        cost = sum(pk.waste(b - a, 64) + pk.SEQUENCE_COST + (0 if b in docs else pk.DOCUMENT_COST) for a, b in zip([0, *cuts], cuts, strict=False))
        # the program looks up sequences of half and of a quarter of the length; the brute force allows every power of two
        assert cost <= brute_cost(ends, docs, int(docs[-1]), 64) + pk.SEQUENCE_COST * len(cuts)


@pytest.mark.parametrize("chunk", [pk.CHUNK_TOKENS, 5000])
def test_every_id_is_in_one_piece_and_padding_is_small(spark, chunk):
    rng = np.random.default_rng(1)
    texts = [*ODD, *(" ".join(rng.choice(["river.", "house", "water,", "Straße", "\n"], int(n))) for n in rng.integers(1, 900, 60)), "word " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS start").repartition(2)

    def run():
        return pk.pack(docs, PATH, with_ids=True).collect()

    from functools import partial

    if chunk != pk.CHUNK_TOKENS:  # executors see a changed default only through the function itself
        batches = list(docs.select("doc_id", "text").toArrow().to_batches())

        class Context:
            @staticmethod
            def get():
                return Context

            partitionId = staticmethod(lambda: 2)  # noqa: N815

        old = pk.CHUNK_TOKENS, pk.TaskContext
        pk.CHUNK_TOKENS, pk.TaskContext = chunk, Context
        try:
            import pyarrow as pa

            from pyspark.sql import Row

            out = [Row(**r) for b in partial(pk._pack, path=PATH, limit=1024, with_ids=True, end_id=0)(iter(batches)) for r in pa.Table.from_batches([b]).to_pylist()]
        finally:
            pk.CHUNK_TOKENS, pk.TaskContext = old
    else:
        out = run()
    whole = Tokenizer.from_file(PATH)
    want = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    pieces, sequences = {}, {}
    for r in out:
        assert r.length == len(r.ids) > 0 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        assert r.doc_tokens == len(want[r.doc_id])
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, ids in want.items():
        got = sorted(pieces[i])
        if i == 3:
            assert len(got) == 2 and got[0] == got[1]
        else:
            assert [x for _, p in got for x in p] == ids
    padding = total = 0
    for parts in sequences.values():
        n = 0
        for offset, length in sorted(parts):
            assert offset == n
            n += length
        assert n <= 1024
        padding, total = padding + pk.waste(n, 1024), total + n
    assert padding < 0.02 * total


def test_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_sentences_shorter_than_the_spacing_still_give_states():
    ends = np.arange(8, 5001, 8)
    documents = np.array([5000])
    assert np.diff(pk._spaced(ends)).tolist() == [16] * 312
    cuts = pk.plan_cuts(ends, documents, 5000, 1024, True)
    assert set(cuts.tolist()[:-3]) <= set(ends.tolist()) and cuts[-1] == 5000
    odd = np.concatenate([np.arange(7, 4000, 7), [4000]])
    cuts = pk.plan_cuts(odd, np.array([4000]), 4000, 64, True)
    assert np.isin(cuts[:-3], odd).all()


def unpruned(ends, documents, total, limit):
    """Least cost over all positions, and where its sequences end."""
    penalty = np.full(total + 1, pk.SEQUENCE_COST + pk.SENTENCE_COST)
    penalty[ends] = pk.SEQUENCE_COST + pk.DOCUMENT_COST
    penalty[documents] = pk.SEQUENCE_COST
    wasted = np.array([pk.waste(n, limit) for n in range(limit, 0, -1)])
    best, back = np.zeros(total + 1, np.int64), np.zeros(total + 1, np.int64)
    for j in range(1, total + 1):
        low = max(0, j - limit)
        cost = best[low:j] + wasted[limit - (j - low) :]
        best[j], back[j] = cost.min() + penalty[j], low + int(cost.argmin())
    cuts, p = [], total
    while p:
        cuts.append(p)
        p = int(back[p])
    return int(best[total]), cuts[::-1]


def test_the_limits_as_shipped_stay_near_the_unpruned_program():
    rng = np.random.default_rng(2)
    documents = np.cumsum(np.clip(rng.lognormal(5.5, 1.1, 150), 5, 20_000).astype(int))
    total = int(documents[-1])
    ends = np.unique(np.concatenate([np.cumsum(rng.integers(2, 40, total // 20)), documents]))
    ends = ends[ends < total]
    least, best = unpruned(ends, documents, total, 1024)
    cuts = pk.plan_cuts(ends, documents, total, 1024, True).tolist()
    cost = padding = inside = 0
    for a, b in zip([0, *cuts], cuts, strict=False):
        kind = 0 if b in documents else pk.DOCUMENT_COST if b in ends else pk.SENTENCE_COST
        padding += pk.waste(b - a, 1024)
        inside += kind == pk.SENTENCE_COST
        cost += pk.waste(b - a, 1024) + pk.SEQUENCE_COST + kind
    assert least <= cost <= 1.35 * least and padding <= 0.012 * total
    assert inside <= 0.35 * len(cuts) and len(cuts) <= 1.1 * len(best)
