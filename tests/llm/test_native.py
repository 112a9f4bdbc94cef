"""Mixing, URL filters, quality, sharding, decontamination and the pipeline against brute force or planted cases."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomlake.llm.decontam import decontaminate
from loomlake.llm.mixing import mix_sources
from loomlake.llm.quality import base_counts, quality_filter
from loomlake.llm.sharding import shard_documents

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e a b c d e"), (4, "a b c d e a b c d e"), (5, "x\nx\n x\n#$\n\n"), (6, "w " * 3000)]


def brute_base(text):
    w, windows = WORDS.findall(text or ""), Counter()
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])] += 1
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if windows[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), sum(hit)


def test_base_counts(spark, docs):
    rows = docs.select("doc_id", "text").collect() + [None]
    cases = [tuple(r) for r in rows[:-1]] + [(1000 + d, t) for d, t in ODD]
    got = base_counts(spark.createDataFrame(cases, "doc_id long, text string")).collect()
    want = Counter((d, *brute_base(t)) for d, t in cases)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want


def test_quality_keeps_good_documents(spark, docs):
    rows = quality_filter(docs.select("doc_id", "text")).collect()
    assert sum(r.kept for r in rows) > 0.6 * len(rows) and not any(r.kept and r.base_failed for r in rows)
    assert quality_filter(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_mix_takes_the_targets(spark, docs):
    rows = mix_sources(docs.select("doc_id", "text", F.when(F.col("source") != "src3", F.col("source")).alias("source"))).collect()
    assert len(rows) == docs.count()
    total = sum(r["size"] for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == round(own[0].target) and own[0].source_size == sum(r["size"] for r in own)
    assert sum({r.source: r.target for r in rows}.values()) == pytest.approx(total)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    assert mix_sources(spark.createDataFrame(ODD, "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))).count() == len(ODD)


def test_shards(spark, docs):
    rows = shard_documents(docs.select("doc_id", "text"), shards=7).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r.text, set()).add(r.shard)
    assert all(len(g) == 1 for g in groups.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 7 and max(sizes.values()) <= 1.05 * min(sizes.values())
    assert shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_decontamination_catches_other_numbers_and_names(spark):
    item = "A train leaves the station at 30 km per hour and Anna waits for 2 hours before she boards, how far does it go?"
    changed = item.replace("30", "45").replace("Anna", "Bela").replace(" 2 ", " 7 ")
    twisted = changed.replace("how far", "how long did Bela's dog, not the cat, sleep")
    clean = "The station is far from the town and a train takes people there each day of the week without any stop at all."
    rows = [(1, f"Some text before. {item} And after."), (2, f"Other text here. {changed}"), (3, clean), (4, None), (5, ""), (5, ""), (6, twisted)]
    got = decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert len(got) == 7 and {r.doc_id for r in got if r.contaminated} >= {1, 2} and not any(r.contaminated for r in got if r.doc_id in (3, 4, 5))
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), none).collect())


def judged(spark, items, texts):
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return [r.item_ids for r in sorted(decontaminate(docs, bench).collect(), key=lambda r: r.doc_id)]


LETTERS = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(300)]


def test_decontamination_adds_up_shifts(spark):
    item, long = LETTERS[:30], LETTERS[100:200]
    inserted = item[:10] + ["oops"] + item[10:20] + ["again"] + item[20:]
    story = "the old man said that Anna walked 25 km to the town where Anna met the baker"
    longer = story.replace("Anna", "Anna Maria").replace("25", "twenty five")
    scattered = item[:9] + LETTERS[200:300] + item[10:13]
    texts = [inserted, long[:40], longer.split(), scattered, long[:20], []]
    assert judged(spark, [" ".join(item), " ".join(long), story], [" ".join(["so", *x, "end"]) for x in texts]) == [[0], [1], [2], [], [], []]


def test_decontamination_counts_literals_whatever_the_slots(spark):
    sums = "the boy put 3 red apples in a bag and then gave 5 green apples to the girl in the park"
    fruit = "a basket holds 2 apples and 2 pears so how many of each fruit will be in the basket after lunch"
    names = "5 so 7 x 8 x 9 x 7 with 1 q 2 r 3"
    texts = [sums.replace("3", "5"), fruit.replace("2", "3", 1).replace(" 2 ", " 4 "), "4 so 4 x 4 x 4 x 5 with 6 q 6 r 6"]
    assert judged(spark, [sums, fruit, names], [f"here {x}" for x in texts]) == [[0], [1], []]


def test_decontamination_finds_short_and_unspaced_items_and_those_of_names(spark):
    items = ["What is the capital of France?", "八段锦第一式怎么做？", "WHO WROTE HAMLET AND MACBETH AND KING LEAR IN LONDON", "Name 3 Primes", "孔子的仁政思想是什么，请举例说明？", "", None]
    texts = [
        "They asked: What is the capital of Spain? Nobody there knew.",
        "昨天有人问我八段锦第一式怎么做？我说不知道。",
        "a quiz had WHO WROTE HAMLET AND MACBETH AND KING LEAR IN LONDON as its last line",
        "the task was name 3 primes and add them",
        "老师问孔子的仁政思想是什么请举例说明然后下课",
        "What is the capital letter of a name, 5 primes or 3 names",
        "今天天气怎么样",
    ]
    assert judged(spark, items, texts) == [[0], [1], [2], [3], [4], [], []]


def brute_coverage(item, text):
    """Words of the item under eight-word windows that the text has too, at the best shift."""
    n, shifts = 8, {}
    for i in range(len(item) - n + 1):
        for j in range(len(text) - n + 1):
            if item[i : i + n] == text[j : j + n]:
                shifts.setdefault(j - i, set()).update(range(i, i + n))
    return max(map(len, shifts.values()), default=0)


def test_decontamination_of_quotes_against_brute_force(spark):
    rng = random.Random(3)
    items = [LETTERS[40 * k : 40 * k + rng.choice([10, 24, 40])] for k in range(4)] + [LETTERS[160:280]]
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        start = rng.randint(0, len(item) - 1)
        noise = [rng.choice(LETTERS[280:]) for _ in range(30)]
        texts.append(noise[:10] + item[start : start + rng.choice([5, 7, 8, 12, 20, 33, 60])] + noise[10:])
    want = [[k for k, item in enumerate(items) if (c := brute_coverage(item, t)) >= 32 or 2 * c >= len(item)] for t in texts]
    assert judged(spark, [" ".join(x) for x in items], [" ".join(t) for t in texts]) == want and any(want) and not all(want)


def test_decontamination_of_odd_tables(spark):
    item = " ".join(LETTERS[:20])
    bench = spark.createDataFrame([("i1", item, 1), ("i1", item, 2), ("i2", None, 3), ("i3", "", 4)], "item_id string, text string, doc_id int")
    docs = spark.createDataFrame([(None, item, "x"), (None, item, "y"), (3, None, "z"), (3, item + " " + "filler " * 300_000, "w")], "doc_id long, text string, item_id string")
    rows = decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or 0, tuple(r.item_ids)) for r in rows) == [(0, ("i1",)), (0, ("i1",)), (3, ()), (3, ("i1",))]
    assert decontaminate(docs.limit(0), bench).count() == 0


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def test_stage_near_duplicates_against_all_pairs(spark, docs, stages):
    sets = {}
    for r in docs.collect():
        w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    least = {d: d for d in sets}

    def root(d):
        while least[d] != d:
            d = least[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    out = stages["near_duplicates"](spark, docs, SF)
    assert sorted(r.doc_id for r in out.collect()) == [d for d in ids if root(d) == d] and out.columns == docs.columns


def test_stages_keep_to_their_operators(spark, docs, stages):
    from loomlake.llm.toxicity import fit_toxicity, toxicity

    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: sorted(r.doc_id for r in df.collect())
    toxic = {r.doc_id for r in toxicity(docs, fit_toxicity(docs, labels)).where("toxic").collect()}
    assert ids(stages["toxicity"](spark, docs, SF)) == [d for d in ids(docs) if d not in toxic]
    held = {r.doc_id for r in decontaminate(docs, bench).where("contaminated").collect()}
    assert ids(stages["decontamination"](spark, docs, SF)) == [d for d in ids(docs) if d not in held] and held
    taken = {r.doc_id: sum(x.first_word == 0 for x in r.draws) if r["size"] else 1 for r in mix_sources(docs).collect()}
    assert Counter(ids(stages["mixing"](spark, docs, SF))) == Counter({d: n for d, n in taken.items() if n})


def test_pipeline_of_odd_tables(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, rid string, shard int, severity double"
    odd = [(None, None, None, None, None, "a", 1, 0.0), (1, "", "en", "s", 0, "b", 1, 0.0), (2, "one two three four five six", "en", None, 27, None, None, None), (2, "seven eight nine ten eleven twelve", "de", "s", 1, "c", 1, 9.0)]
    for name, rows in (("empty", []), ("odd", odd)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / name / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "empty")).count() == 0
    rows = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in rows} >= {None, 1, 2} and len({(r.shard, r.slot) for r in rows}) == len(rows)


def test_pipeline(spark, docs):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in docs.select("doc_id").collect()}
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
