"""The LM query against plain counts in which n-grams seen once have their nodes too."""

import collections
import math

from harborline.llm import lm_scoring


def test_query_keeps_ngrams_seen_once(spark, tmp_path):
    rows = [(i, f"alpha{i} beta{i} gamma{i} the cat sat on mat{i % 5}") for i in range(60)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(rows[:20])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in lm_scoring.op2_lm_scoring(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and len({r.held_out for r in got.values()}) == 2
    seqs = [[*t.split(), "\0"] for i, t in rows if not got[i].held_out]
    c1, c2, c3 = (collections.Counter(g for w in seqs for g in zip(*(w[k:] for k in range(n)), strict=False)) for n in (1, 2, 3))
    assert sum(n == 1 for n in c2.values()) > 50 and sum(n == 1 for n in c3.values()) > 50
    a2, a3 = ({k: (v - 0.75) / c[k[:-1]] for k, v in counts.items()} for c, counts in ((c1, c2), (c2, c3)))
    g1, g2 = collections.defaultdict(lambda: 1.0), collections.defaultdict(lambda: 1.0)
    for g, a in ((g1, a2), (g2, a3)):
        for k, v in a.items():
            g[k[:-1]] -= v
    for i, t in rows:
        w, score = [*t.split(), "\0"], 0.0
        for j, x in enumerate(w):
            p = (c1[(x,)] + 1) / (sum(c1.values()) + len(c1) + 1)
            if j:
                p = a2.get((w[j - 1], x), 0) + g1[(w[j - 1],)] * p
            if j > 1 and (w[j - 2], w[j - 1]) in a2:
                p = a3.get((w[j - 2], w[j - 1], x), 0) + g2[w[j - 2], w[j - 1]] * p
            score += math.log10(p)
        assert abs(got[i].score - score) < 0.02 * len(w)
