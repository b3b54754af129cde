"""The corpus pipeline, stage by stage, against a brute-force version."""

import random
import re
from collections import Counter

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    m = min(n, len(w))
    return {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()


def test_stages_and_run(spark, tmp_path):
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(300)]
    rows, toxic = [], set()
    for i in range(160):
        words = [rng.choice(vocab) for _ in range(rng.randint(30, 90))]
        if i % 5 == 1:
            words[10:16] = [rng.choice(["vilest", "foulmouth", "vilely"]) for _ in range(6)]
            toxic.add(i)
        rows.append((i, " ".join(words), "en", ["a", "b", None][i % 3], 0))
    rows += [(200 + k, rows[k][1].replace(" ", "  "), "en", "b", 0) for k in (0, 2, 3)]  # copies but for white space
    rows += [(300 + k, rows[k][1] + " tail", "en", "a", 0) for k in (4, 5, 7)]  # near copies
    rows += [(400, None, "en", "a", 0), (401, "", None, "b", 0)]
    text = {i: t or "" for i, t, *_ in rows}
    source = {i: s for i, _, _, s, _ in rows}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i in toxic)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mix_sources", "best_fit_packing"]
    here, kept = docs, {i for i in text}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        here = stage(spark, here, str(tmp_path)).cache()
        got = Counter(r.doc_id for r in here.collect())
        assert here.columns == docs.columns
        if name == "toxicity":
            kept = {i for i in kept if not (i in toxic or (300 <= i < 400 and i - 300 in toxic))}
        elif name == "exact_dedup":
            groups = {}
            for i in kept:
                groups.setdefault(re.sub(r"\s", "", text[i]), []).append((-len(text[i]), i))
            kept = {min(g)[1] for g in groups.values()}
        elif name == "ngram_jaccard_join":
            sets = {i: shingles(text[i]) for i in kept}
            kept = {i for i in kept if not any(j < i and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in kept)}
        if name != "mix_sources":
            assert set(got) == kept and max(got.values()) == 1, name
        else:
            assert set(got) <= kept and max(got.values()) <= 3
            # Words of a source come near its target: a few blocks of 16 words short, and one document taken in part.
            sizes = Counter()
            for i in kept:
                sizes[source[i]] += len(WORD.findall(text[i]))
            left, target = sum(sizes.values()), {}
            weight = {"a": 1, "b": 2, None: 3}
            for s in sorted(sizes, key=lambda s: sizes[s] / weight[s]):
                share = left * weight[s] / sum(weight[x] for x in sizes if x not in target)
                target[s] = min(share, 3 * sizes[s])
                left -= target[s]
            mixed = Counter()
            for i, n in got.items():
                mixed[source[i]] += n * len(WORD.findall(text[i]))
            assert all(abs(mixed[s] - target[s]) <= 4 * 16 + 90 for s in sizes), (mixed, target)
    size = {i: len(WORD.findall(text[i])) for i in text}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total, fill = Counter(), Counter()
    for r in packed:
        total[r.doc_id] += r["size"]
        fill[r.bin] += r["size"]
    assert total == Counter({i: n * size[i] for i, n in got.items()}) and set(total) == set(got)
    assert max(fill.values()) <= 2048
    for b in fill:
        clusters = [r.cluster for r in packed if r.bin == b and r.cluster is not None]
        assert len(clusters) == len(set(clusters))
