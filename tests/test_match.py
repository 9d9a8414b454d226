import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from hirelake.operators import cells, embed, match, providers
from hirelake.operators.match import Rules

# Executors need the classes of this file but cannot import it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PEOPLE = "profile_id bigint, embedding array<double>, home string, floor double"
JOBS = "job_id bigint, embedding array<double>, place string, comp double"


def frames(spark, n_people=20, n_jobs=90):
    rng = np.random.default_rng(11)
    people = [(i, rng.standard_normal(6).tolist(), ["x", "y", None][i % 3], [None, 50.0][i % 2])
              for i in range(n_people)]
    jobs = [(i, rng.standard_normal(6).tolist(), ["x", "y", None][i % 3], [None, 40.0, 60.0, 90.0][i % 4])
            for i in range(n_jobs)]
    jobs[7] = (7, jobs[6][1], "x", 60.0)  # a tie
    jobs[8] = (8, [0.0] * 6, "y", 60.0)  # a zero vector
    return people, jobs, spark.createDataFrame(people, PEOPLE), spark.createDataFrame(jobs, JOBS).repartition(5)


def brute(people, jobs, k, allowed):
    def cos(a, b):
        a, b = np.array(a), np.array(b)
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 6) if n else 0.0

    out = {}
    for p in people:
        scored = sorted((-cos(p[1], j[1]), j[0]) for j in jobs if allowed(p, j))
        out[p[0]] = [j for _, j in scored[:k]]
    return {p: v for p, v in out.items() if v}


def ranking(df):
    out = {}
    for r in df.orderBy("profile_id", "rank").collect():
        out.setdefault(r.profile_id, []).append(r.job_id)
    return out


def wished(p, j):
    return (p[2] is None or p[2] == j[2]) and (p[3] is None or (j[3] is not None and j[3] >= p[3]))


WISH = Rules(equal=(("place", "home"),), at_least=(("comp", "floor"),))


def test_filters_come_before_the_top_k(spark):
    people, jobs, a, b = frames(spark)
    want = brute(people, jobs, 4, wished)
    assert ranking(match.match(a, b, 4, WISH)) == want
    assert ranking(match.top_matches(a, b, 4, WISH, tile_rows=9)) == want
    assert ranking(match.top_matches(a, b, 4, WISH, tile_rows=3, n_cells=20)) == want


def test_a_search_in_turns_finds_the_same(spark, monkeypatch):
    people, jobs, a, b = frames(spark, 60, 240)
    cut, kernels = [], cells.materialize
    monkeypatch.setattr(cells, "TURN_ROWS", 1)
    monkeypatch.setattr(cells, "materialize", lambda df, label: cut.append(label) or kernels(df, label))
    for rules, allowed in ((Rules(), lambda p, j: True), (WISH, wished)):
        for n_cells in (1, 24):  # all cells at once, and the near ones first
            cut.clear()
            found = match.top_matches(a, b, 4, rules, tile_rows=2, n_cells=n_cells)
            assert ranking(found) == brute(people, jobs, 4, allowed)
            assert cut.count("best") > 2 or rules.equal  # a turn's shuffle is bounded by the rows of both sides


def test_approximate_results_are_allowed_and_correctly_scored(spark):
    people, jobs, a, b = frames(spark)
    near = match.top_matches(a, b, 4, WISH, tile_rows=16, n_cells=20, recall=0.95)
    rows = near.collect()
    assert all(wished(people[r.profile_id], jobs[r.job_id]) for r in rows)
    exact = {(r.profile_id, r.job_id): r.score for r in match.match(a, b, 90, WISH).collect()}
    assert all(exact[r.profile_id, r.job_id] == r.score for r in rows)
    best = brute(people, jobs, 4, wished)
    hits = sum(r.job_id in best[r.profile_id] for r in rows)
    assert hits / sum(map(len, best.values())) >= 0.9


def test_rows_without_a_vector_take_no_part(spark):
    _, _, a, b = frames(spark)
    holes = [(900, None, "x", 60.0), (901, [], "y", 60.0), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0], "x", 60.0),
             (903, [float("nan"), *[1.0] * 5], "x", 60.0), (904, [float("inf"), *[1.0] * 5], "x", 60.0)]
    more_jobs = spark.createDataFrame(holes, JOBS).unionByName(b)
    more_people = spark.createDataFrame(holes, PEOPLE).unionByName(a)
    want = ranking(match.match(a, b, 4, WISH))
    assert ranking(match.match(more_people, more_jobs, 4, WISH)) == want
    assert ranking(match.top_matches(more_people, more_jobs, 4, WISH, tile_rows=9, n_cells=12)) == want
    assert ranking(match.match_ann(more_people, more_jobs, 4, WISH)) == ranking(match.match_ann(a, b, 4, WISH))


def test_approximate_recall_holds_with_size(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    rows = [(i, (centres[i % 40] + 0.6 * rng.standard_normal(16)).tolist()) for i in range(20_000)]
    jobs = spark.createDataFrame(rows, "job_id bigint, embedding array<double>").repartition(8)
    people = jobs.where("job_id < 50").withColumnRenamed("job_id", "profile_id")
    for share in (jobs.where("job_id % 10 = 0"), jobs):
        best = {(r.profile_id, r.job_id) for r in match.match(people, share, 10).collect()}
        near = {(r.profile_id, r.job_id) for r in match.match_ann(people, share, 10).collect()}
        assert len(best & near) / len(best) >= 0.95


@pytest.fixture(scope="module")
def clustered(spark):
    """200,000 vectors around 400 centres, with two columns to filter by."""
    from hirelake.session import materialize
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((400, 16))

    def make(frames):
        for f in frames:
            spot = np.random.default_rng(int(f["id"].iloc[0]))
            v = centres[f["id"] % 400] + 0.7 * spot.standard_normal((len(f), 16))
            yield f.assign(embedding=list(v), place=[str(x) for x in f["id"] % 7], comp=(f["id"] % 100).astype(float)).rename(
                columns={"id": "job_id"})

    return materialize(spark.range(200_000, numPartitions=16).mapInPandas(
        make, "job_id bigint, embedding array<double>, place string, comp double"), "clustered")


def people_of(jobs, n):
    return jobs.where(f"job_id < {n}").select(
        F.col("job_id").alias("profile_id"), "embedding", F.when(F.col("job_id") % 3 > 0, F.col("place")).alias("home"),
        F.when(F.col("job_id") % 2 == 0, 97.0).alias("floor"))


def test_stored_index_finds_the_best_with_filters_and_grows(spark, clustered, tmp_path):
    people, path = people_of(clustered, 300), str(tmp_path / "index")
    cells.write_index(clustered.where("job_id % 4 = 0"), path, cells=256)
    before = spark.read.parquet(f"{path}/rows").inputFiles()
    cells.add_to_index(clustered.where("job_id % 4 <> 0"), path)
    assert set(before) < set(spark.read.parquet(f"{path}/rows").inputFiles())
    assert spark.read.parquet(f"{path}/rows").count() == 200_000
    for rules in (Rules(), WISH):
        met = match.searched(people, cells.read_index(spark, path), 10, rules, recall=0.95)
        near = {(r.profile_id, r.job_id): r.score for r in met[0].collect()}
        best = {(r.profile_id, r.job_id): r.score for r in match.match(people, clustered, 10, rules).collect()}
        assert len(best) == 3000  # every profile has k allowed jobs, and gets them
        assert len(near) == 3000 and len(best.keys() & near.keys()) / 3000 >= 0.95
        assert all(best[x] == near[x] for x in best.keys() & near.keys())
        seen = met[1].agg(F.avg("met")).first()[0]
        assert seen < 80_000  # of 200,000 rows; these clusters overlap


def test_bounds_rule_out_cells_and_lose_nothing(spark, clustered):
    """Tight clusters: the exact search meets few rows, and finds what all rows hold."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((50, 12))
    rows = [(i, (centres[i % 50] + 0.05 * rng.standard_normal(12)).tolist()) for i in range(6000)]
    jobs = spark.createDataFrame(rows, "job_id bigint, embedding array<double>")
    people = jobs.where("job_id < 200").withColumnRenamed("job_id", "profile_id")
    found, met = match.searched(people, match.in_cells(jobs, n_cells=60), 5)
    everything = match.searched(people, match.in_cells(jobs, n_cells=1), 5)[0]
    assert ranking(found) == ranking(everything)
    share = met.agg(F.avg("met")).first()[0] / 6000
    assert share < 0.25


def test_a_hot_cell_is_many_tiles_and_ties_keep_the_smaller_id(spark):
    jobs = spark.createDataFrame([(i, [1.0, 0.0] if i % 3 else [float(i), 1.0]) for i in range(3000)],
                                 "job_id bigint, embedding array<double>")
    people = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 0.0])], "profile_id bigint, embedding array<double>")
    got = ranking(match.top_matches(people, jobs, 5, tile_rows=50, n_cells=30))
    assert got[0] == [1, 2, 4, 5, 7] and got[1] == [0, 1, 2, 3, 4]


def test_lengths_must_agree(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "profile_id bigint, embedding array<double>")
    b = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "job_id bigint, embedding array<double>")
    with pytest.raises(ValueError, match="different lengths"):
        match.match(a, b, 3).collect()
    with pytest.raises(ValueError, match="different lengths"):
        match.match(a, b.unionByName(spark.createDataFrame([(2, [1.0])], b.schema)), 3).collect()


def test_huge_components_do_not_overflow(spark):
    a = spark.createDataFrame([(1, [1e200, 0.0]), (2, [1e-200, 1e-200])], "profile_id bigint, embedding array<double>")
    b = spark.createDataFrame([(1, [1e250, 0.0]), (2, [0.0, 3.0])], "job_id bigint, embedding array<double>")
    rows = {(r.profile_id, r.job_id): r.score for r in match.match(a, b, 2).collect()}
    assert rows == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.707107, (2, 2): 0.707107}


def test_empty_sides(spark):
    _, _, a, b = frames(spark)
    assert match.top_matches(a.limit(0), b, 3).count() == 0
    assert match.top_matches(a, b.limit(0), 3).count() == 0


def test_models_must_agree(spark):
    _, _, a, b = frames(spark)
    with pytest.raises(ValueError):
        match.top_matches(a.withColumn("model_id", F.lit("m1")), b.withColumn("model_id", F.lit("m2")), 3)
    with pytest.raises(ValueError):
        match.top_matches(a.withColumn("model_id", F.lit("m1")), b, 3)
    assert embed.assert_same_model(a.withColumn("model_id", F.lit("m1"))) == "m1"


class Lengths:
    model_id = "lengths"

    def encode(self, texts):
        return [[float(len(t)), 1.0] for t in texts]


def test_providers_can_be_swapped(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "posting_id bigint, description string")
    rows = {r.posting_id: r for r in embed.embed(docs, Lengths()).collect()}
    assert rows[1].embedding == [3.0, 1.0] and rows[2].embedding == [0.0, 1.0]
    assert rows[1].model_id == "lengths"
    hashed = embed.embed(docs, embed.HashingEmbedding(16)).collect()
    assert [round(sum(x * x for x in r.embedding), 5) for r in hashed] == [1.0, 0.0]


def test_only_new_changed_or_foreign_vectors_are_pending(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "posting_id bigint, description string")
    store = embed.embed(docs.where("posting_id < 4"), Lengths()).select("posting_id", "model_id", "text_hash")
    store = store.withColumn("text_hash", F.when(F.col("posting_id") == 2, "old").otherwise(F.col("text_hash")))
    store = store.withColumn("model_id", F.when(F.col("posting_id") == 3, "other").otherwise(F.col("model_id")))
    assert {r.posting_id for r in embed.pending_embeddings(docs, store, "lengths").collect()} == {2, 3, 4}


def test_explanations(spark):
    rows = spark.createDataFrame([
        (1, 1, ["sql", "go"], ["go", "java", "sql"]), (1, 2, ["c"], ["go"]), (1, 3, [], [])],
        "profile_id bigint, job_id bigint, job_skills array<string>, profile_skills array<string>")
    got = [r.explanation for r in match.phrase(match.explain(rows)).orderBy("job_id").collect()]
    assert got[0] == "Matches 2 of 2 listed skills: go, sql."
    assert got[1] == got[2] == "Similar wording; no listed skill in common."


def test_template_column_equals_its_texts(spark):
    provider = embed.TemplateProvider("Hi,", "Bye")
    prompts = [("a",), ("",), (None,), ("two\nlines",)]
    got = embed.generate(spark.createDataFrame(prompts, "prompt string"), "prompt", provider).collect()
    assert [r.completion for r in got] == provider.complete([p or "" for p, in prompts])


def test_fitted_embedding_is_versioned_and_asks_for_new_vectors(spark, tmp_path):
    docs = spark.createDataFrame([(1, "sql go sql"), (2, "go"), (3, None), (4, "")], "posting_id bigint, description string")
    model = embed.FittedEmbedding.fit(docs, dim=16)
    rows = {r.posting_id: r for r in embed.embed(docs, model).collect()}
    slots = embed.WordSlots(16)
    sql, go = slots["sql"], slots["go"]
    assert sql != go and model.n_texts == 4 and (model.uses[sql], model.uses[go], sum(model.uses)) == (1, 2, 3)
    want = np.zeros(16)
    want[sql], want[go] = 2 * np.log(5 / 2), np.log(5 / 3)
    assert np.allclose(rows[1].embedding, want / np.linalg.norm(want), atol=1e-6)
    assert rows[2].embedding[go] == 1.0 and not any(rows[3].embedding) and not any(rows[4].embedding)
    assert embed.FittedEmbedding.fit(docs.repartition(3), dim=16).model_id == model.model_id
    model.save(spark, str(tmp_path))
    assert embed.FittedEmbedding.load(spark, str(tmp_path), model.model_id).uses == model.uses
    store = embed.embed(docs, model).select("posting_id", "model_id", "text_hash")
    assert embed.pending_embeddings(docs, store, model.model_id).count() == 0
    again = embed.FittedEmbedding.fit(docs.unionByName(docs.where("posting_id = 1")), dim=16)
    assert again.model_id != model.model_id
    assert embed.pending_embeddings(docs, store, again.model_id).count() == 4
    assert embed.FittedEmbedding.fit(docs.limit(0), dim=16).uses == [0] * 16


def test_providers_are_named_by_the_configuration(spark, tmp_path):
    docs = spark.createDataFrame([(1, "spark sql"), (2, "sql")], "posting_id bigint, description string")
    fitted = embed.FittedEmbedding.fit(docs, dim=16)
    fitted.save(spark, str(tmp_path))
    try:
        assert providers.embedding(spark).model_id == "hashing-tf-256"
        spark.conf.set(providers.EMBEDDING, "hashing:64")
        assert providers.embedding(spark).model_id == "hashing-tf-64"
        spark.conf.set(providers.EMBEDDING, f"fitted:{tmp_path}/{fitted.model_id}")
        assert providers.embedding(spark).uses == fitted.uses
        providers.register(providers.LLM, "loud", lambda spark, tone: embed.TemplateProvider("HELLO", tone))
        spark.conf.set(providers.LLM, "loud:BYE")
        assert providers.llm(spark).complete(["x"]) == ["HELLO\n\nx\n\nBYE"]
        spark.conf.set(providers.LLM, "unheard")
        with pytest.raises(ValueError):
            providers.llm(spark)
    finally:
        spark.conf.unset(providers.EMBEDDING)
        spark.conf.unset(providers.LLM)


def test_a_resume_gets_jobs_with_reasons(spark):
    jobs = spark.createDataFrame([(1, "spark and sql at scale", "berlin", 2), (2, "garden work", "berlin", 9), (3, "spark sql", "rome", 9)],
                                 "job_id bigint, description string, location string, level int")
    model = embed.HashingEmbedding(512)
    resumes = spark.createDataFrame([(7, "I know SQL, Apache Spark", 1), (8, None, 5)], "profile_id bigint, text string, least int")
    words = spark.createDataFrame([("Spark", "apache spark"), ("Spark", "spark"), ("SQL", "sql")], "skill string, alias string")
    got = match.match_resumes(resumes, embed.embed(jobs, model), words, model, 1, match.Rules(at_least=(("level", "least"),)),
                              location="berlin")
    assert {r.profile_id: (r.job_id, r.explanation) for r in got.collect()} == {
        7: (1, "Matches 2 of 2 listed skills: SQL, Spark."), 8: (2, "Similar wording; no listed skill in common.")}
