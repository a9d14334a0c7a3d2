import collections
import re

import corpus_pipeline as cp
from oracle import connect
from test_decontam import brute as windows_of

from rulelake.llm import mixing, toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()), key=repr)


def near_brute(docs):
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for d, t, *_ in docs}
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    above = {d: d for d in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                above[y] = x
    return {d for d in ids if root(d) == d}


def test_each_stage_does_its_whole_job(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in cp.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    inputs, outputs = {}, {}
    for name, stage in cp.STAGES:
        inputs[name] = docs
        out = stage(spark, docs, SF)
        assert name == "sharding" or out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        outputs[name] = docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")

    model = toxicity.toxicity_model(inputs["toxicity"], spark.read.parquet(f"{SF}/labels.parquet"))
    machine = model.automaton()
    assert rows(outputs["toxicity"]) == [r for r in rows(inputs["toxicity"]) if model.score(r[1], machine) < 0.5]

    kept = near_brute(rows(inputs["near_duplicates"]))
    assert rows(outputs["near_duplicates"]) == [r for r in rows(inputs["near_duplicates"]) if r[0] in kept]

    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in windows_of([r[:2] for r in rows(inputs["decontamination"])], items, 10) if r[2]}
    assert rows(outputs["decontamination"]) == [r for r in rows(inputs["decontamination"]) if r[0] not in hit]

    inputs["mixing"].write.parquet(f"{tmp_path}/mix/documents.parquet")
    found = connect(f"{tmp_path}/mix").execute(mixing.OP1_SQL)
    names = [c[0] for c in found.description]
    copies = {r[0]: r[4] // r[1] if r[1] else 0 for r in ([dict(zip(names, x, strict=True))[c] for c in ("doc_id", "size", "source_size", "target", "taken")] for x in found.fetchall())}
    assert collections.Counter(r[0] for r in rows(outputs["mixing"])) == collections.Counter({d: n for d, n in copies.items() if n})

    assert rows(outputs["sharding"]) == rows(outputs["mixing"])
    assert rows(cp.run(spark, SF)) == rows(outputs["sharding"])
