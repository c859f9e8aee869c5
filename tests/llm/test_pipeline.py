"""The corpus pipeline against a brute-force version of its stages on a small corpus."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from evidmill.llm import language_id, toxicity

BAD = ["vorgul", "krexish"]
STEMS = {"aa": "kan tor lem vis dro mil", "bb": "shu qui zee pho wex jaw"}


def corpus():
    rng = random.Random(8)
    docs, labels = [], []

    def words(lang, n):
        stems = STEMS[lang].split()
        return ["".join(rng.choice(stems) for _ in range(3)) for _ in range(n)]

    for i in range(420):
        lang = rng.choice(["aa", "bb"])
        kind = rng.random()
        if docs and kind < 0.12:
            text = rng.choice(docs)[1].replace(" ", rng.choice([" ", "  ", "\n"]))
        elif docs and kind < 0.3:
            parts = rng.choice(docs)[1].split(" ")
            parts[rng.randrange(len(parts))] = words(lang, 1)[0]
            text = " ".join(parts)
        else:
            text = " ".join(words(lang, rng.choice([3, 40, 90])))
        toxic = any(b in text for b in BAD)
        if not toxic and rng.random() < 0.2:
            text, toxic = f"{text}. {rng.choice(BAD)} {rng.choice(BAD)}", True
        docs.append((i, text, lang, "src", len(text)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, "12 %%% 34", "aa", "src", 9), (1001, None, None, "src", 0), (1002, "", "bb", None, None)]
    return docs, labels


def components(sets):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    return {i: top(i) for i in ids}


def test_like_brute_force(spark, tmp_path):
    docs, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {d[0]: d[1] for d in docs}

    # Stage by stage: the same rules over a dictionary of texts.
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    scorer = toxicity.Scorer(toxicity.fit(table, marks))
    kept = {i: t for i, t in kept.items() if scorer.score(t)[0] < 0.7}
    gone = {d[0] for d in docs} - set(kept)
    toxic = {i for i, _, y in labels if y}
    assert len(gone & toxic) >= 0.95 * len(toxic) and not gone - toxic

    rest = spark.createDataFrame([d for d in docs if d[0] in kept], schema).where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1")
    ready = language_id.Classifier(language_id.fit(rest))
    kept = {i: t for i, t in kept.items() if not ready.classify(t)[3]}
    assert {1000, 1001, 1002}.isdisjoint(kept)

    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append(i)
    kept = {i: kept[i] for i in (min(g, key=lambda i: (-len(kept[i]), i)) for g in groups.values())}

    split = {i: t.encode().lower().split() for i, t in kept.items()}
    top = components({i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in split.items()})
    kept = {i: t for i, t in kept.items() if top[i] == i}
    assert 50 < len(kept) < 300

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(kept)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in got:
        ids = tokenizer.encode(kept[r.doc_id], add_special_tokens=False).ids + [2]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes())
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns(spark, tmp_path):
    docs, labels = corpus()
    table = spark.createDataFrame([(*d, "more", 1) for d in docs[:60]], "doc_id long, text string, lang string, source string, n_chars long, score string, kept int")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, table, str(tmp_path)).columns == table.columns
    empty = table.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None
