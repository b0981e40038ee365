"""Record linkage end to end: block, score, decide; train with honest folds; resolve new records.

Lineage is cut, by a checkpoint in the shared folder, after prepare, block, pair features and scores.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import kernels
from weftline.functions.tokens import literal_map
from weftline.operators import context, decide, lexicon, metrics, models, retrieval
from weftline.operators.features import CHANNELS, CONTEXT_FEATURES, PAIR_FEATURES, idf, name_counts, pair_features, prepare, record_keys
from weftline.sources.cut import cut

#: Thresholds tried for pruning; fixed values.
PRUNE_GRID = [0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2]


@dataclass
class Rule:
    """How probabilities become answers: ``threshold`` or ``expected_f``, on calibrated and exclusive ones or not."""

    kind: str = "expected_f"
    threshold: float = 0.5
    calibrated: bool = False
    exclusive: bool = True

    @property
    def name(self) -> str:
        base = "global threshold (tuned)" if self.kind == "threshold" else f"expected-F0.5, {'isotonic' if self.calibrated else 'model'} p"
        return base + " + exclusivity" * self.exclusive


@dataclass
class Bundle:
    pruners: list
    matchers: list
    tau: float
    rule: Rule
    calibrator: IsotonicRegressionModel
    report: dict = field(default_factory=dict)
    words: lexicon.Lexicon = field(default_factory=lexicon.Lexicon)


def save(bundle: Bundle, spark: SparkSession, path: str) -> None:
    """Spark ML models and one line of JSON, in any store that Spark writes."""
    for kind, found in (("pruner", bundle.pruners), ("matcher", bundle.matchers)):
        for k, m in enumerate(found):
            m.write().overwrite().save(f"{path}/{kind}-{k}")
    bundle.calibrator.write().overwrite().save(f"{path}/calibrator")
    words = {"abbreviations": bundle.words.abbreviations, "legal": sorted(bundle.words.legal), "cues": sorted(bundle.words.cues)}
    kind = "gbt" if isinstance(bundle.pruners[0], GBTClassificationModel) else "logistic"
    meta = {"kind": kind, "pruners": len(bundle.pruners), "matchers": len(bundle.matchers), "tau": bundle.tau, "rule": asdict(bundle.rule), "report": bundle.report, "words": words}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Bundle:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    model = GBTClassificationModel if meta["kind"] == "gbt" else LogisticRegressionModel
    read = lambda kind: [model.load(f"{path}/{kind}-{k}") for k in range(meta[f"{kind}s"])]
    words = lexicon.Lexicon(meta["words"]["abbreviations"], set(meta["words"]["legal"]), set(meta["words"]["cues"]))
    return Bundle(read("pruner"), read("matcher"), meta["tau"], Rule(**meta["rule"]), IsotonicRegressionModel.load(f"{path}/calibrator"), meta["report"], words)


def views(p: DataFrame) -> DataFrame:
    """(id, src, name_char, full_char, word): the texts that retrieval compares."""
    core = F.when(F.col("core_str") != "", F.col("core_str")).otherwise(F.col("name_str"))
    return p.select("id", "src", core.alias("name_char"), F.concat_ws(" ", "core_str", "addr_str").alias("full_char"), F.concat_ws(" ", "name_str", "addr_str", F.array_join("numbers", " ")).alias("word"))


def prepared(records: DataFrame, words: lexicon.Lexicon) -> DataFrame:
    return cut(prepare(records, words.abbreviations, words.legal, words.cues))


def label_groups(p: DataFrame) -> dict[str, str]:
    """Country labels that name one country: those of nearest neighbours by name and address."""
    x = cut(retrieval.postings(views(p).select("id", "src", retrieval.char_terms(F.col("full_char"), 3, 3).alias("terms")), min_df=2, max_df=0.5))
    best = retrieval.top_k(retrieval.cosine_best(x, 1, 0), "i", "j", 1)
    of = p.select("id", "country")
    links = best.join(of.select(F.col("id").alias("i"), F.col("country").alias("a")), "i").join(of.select(F.col("id").alias("j"), F.col("country").alias("b")), "j")
    return lexicon.country_groups(links.select("a", "b", "sim"), p.where("country <> ''").groupBy(F.col("country").alias("label")).agg(F.count("*").alias("n")))


def channel_terms(p: DataFrame) -> dict[str, tuple[DataFrame, dict]]:
    """By channel the (id, src, terms) of records and the bounds of the terms' frequencies."""
    v = views(p)
    made = {"name_char": (retrieval.char_terms(F.col("name_char"), 2, 4), {"min_df": 2}), "full_char": (retrieval.char_terms(F.col("full_char"), 3, 3), {"min_df": 2, "max_df": 0.5}), "word": (retrieval.word_terms(F.col("word")), {})}
    return {name: (v.select("id", "src", terms.alias("terms")), bounds) for name, (terms, bounds) in made.items()}


def channel_pairs(p: DataFrame, k: int = retrieval.TOP, *, df_cap: int | None = None) -> dict[str, DataFrame]:
    """By channel the pairs (i, j, sim) that hold the ``k`` best of each reference record and the best of each other one.

    All terms count, as products of blocks; with ``df_cap`` commoner terms are dropped, and pairs come by a join on the rest.
    """
    out = {}
    for name, (x, bounds) in channel_terms(p).items():
        made = cut(retrieval.postings(x, **bounds))
        out[name] = retrieval.cosine_pairs(made, df_cap=df_cap) if df_cap else retrieval.cosine_best(made, k, max(3, k // 4))
    keys = p.select("id", "src", record_keys().alias("keys"))
    return out | {"keys": retrieval.key_pairs(retrieval.block_keys(keys))}


def block(p: DataFrame, *, k: int = retrieval.TOP, pool: int = retrieval.POOL, df_cap: int | None = None) -> DataFrame:
    """The fused pool of candidate pairs of prepared records."""
    rows = None
    for name, pairs in channel_pairs(p, k, df_cap=df_cap).items():
        pairs = cut(pairs)
        got = retrieval.channel(pairs, name, k) if name != "keys" else retrieval.top_k(pairs, "i", "j", k).select("i", "j", F.lit("keys").alias("ch"), "rank", "sim")
        rows = got if rows is None else rows.unionByName(got)
    return retrieval.fuse(rows, CHANNELS, pool=pool)


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """y: whether the pair is in the truth (i, j)."""
    return pairs.join(truth.select("i", "j").distinct().withColumn("y", F.lit(1.0)), ["i", "j"], "left").fillna(0.0, ["y"])


def context_features(scored: DataFrame, p: DataFrame) -> DataFrame:
    """The context columns of pairs (i, j, p) over the whole pool, before it is cut."""
    base = scored.select("i", "j", "p")
    x = context.exclusive_share(context.margins(context.ranks_and_gaps(base)))
    strong = base.where("p >= 0.3").select("i", F.col("j").alias("j2"))
    texts = p.where("src <> 1").select("id", "name_str", "addr_str")
    met = base.select("i", "j").join(strong, "i").where("j <> j2").select("j", "j2").distinct()
    met = met.join(texts.select(F.col("id").alias("j"), F.col("name_str").alias("n1"), F.col("addr_str").alias("a1")), "j").join(texts.select(F.col("id").alias("j2"), F.col("name_str").alias("n2"), F.col("addr_str").alias("a2")), "j2")
    alike = met.select("j", "j2", ((kernels.token_set_ratio(F.col("n1"), F.col("n2")) + kernels.token_set_ratio(F.col("a1"), F.col("a2"))) / 2).alias("s"))
    out = x.join(context.sibling_support(base, alike), ["i", "j"]).withColumn("ctx_p", F.col("p"))
    return out.select("i", "j", *[F.col(c).cast("double").alias(c) for c in CONTEXT_FEATURES])


def answer(scored: DataFrame, rule: Rule) -> DataFrame:
    """(i, j) that are emitted."""
    p = scored.withColumn("p", F.col("pc")) if rule.calibrated else scored
    if rule.exclusive:
        p = decide.exclusive(p).withColumn("p", F.col("q"))
    if rule.kind == "threshold":
        return p.where(F.col("p") >= rule.threshold).select("i", "j")
    return decide.choose_sets(p).select("i", F.explode("ids").alias("j"))


def unseen_share(p: DataFrame, coming: DataFrame | None) -> float:
    """The share of coming reference records whose country label no training record has."""
    if coming is None:
        return 0.0
    known = p.select("country").distinct()
    asked = coming.where("src = 1").select("country")
    unseen = asked.join(known, "country", "left_anti").count()
    return unseen / max(asked.count(), 1)


def train(records: DataFrame, truth: DataFrame, *, kind: str = "gbt", rounds: int = 20, most_lost: float = 0.003, coming: DataFrame | None = None, by_country: bool = False) -> Bundle:
    """Fits pruner and matcher with folds by entity and picks the rule with the best macro F0.5.

    ``coming``: the records that will be predicted, without their truth; their names help to find name tails. With
    ``by_country`` the rules are also scored with folds by country group, with the thresholds and the pruning found
    before, and weighed by the share of coming records whose country wasn't seen.
    """
    words = lexicon.fit(records, truth, coming)
    p = prepared(records, words)
    groups = label_groups(p)
    x = cut(label(pair_features(cut(block(p)), p, groups), truth).withColumn("fold", models.fold_of(F.col("i"))))
    universe = p.where("src = 1").select(F.col("id").alias("i"))
    options = {"kind": kind, "rounds": rounds} if kind == "gbt" else {"kind": kind}

    def scored_by(fold: DataFrame, tau: float | None = None) -> tuple[DataFrame, list, list, float]:
        first, pruners = models.cross_fit(fold, PAIR_FEATURES, **options)
        first = cut(first)
        if tau is None:
            tau = metrics.choose_threshold(metrics.prune_curve(first, PRUNE_GRID), most_lost) or PRUNE_GRID[0]
        ctx = cut(context_features(first, p))
        second, matchers = models.cross_fit(first.where(F.col("p") >= tau).drop("p").join(ctx, ["i", "j"]), PAIR_FEATURES + CONTEXT_FEATURES, **options)
        return cut(models.calibrated(cut(second))), pruners, matchers, tau

    def rules(scored: DataFrame) -> dict[str, tuple[float, Rule]]:
        found = {}
        for exclusive in (False, True):
            base = decide.exclusive(scored).withColumn("p", F.col("q")) if exclusive else scored
            curve = metrics.threshold_scores(universe, base).orderBy(F.desc(F.round("macro_f", 9)), "t").first()
            tried = [Rule("threshold", curve.t, False, exclusive), Rule("expected_f", 0.5, True, exclusive), Rule("expected_f", 0.5, False, exclusive)]
            for rule in tried:
                f = metrics.score(universe, answer(scored, rule), truth).first().macro_f
                found[rule.name] = (f, rule)
        return found

    scored, pruners, matchers, tau = scored_by(x)
    cv = rules(scored)
    value = {n: f for n, (f, _) in cv.items()}
    report = {"cv": value, "tau": tau, "importance": models.importances(matchers, PAIR_FEATURES + CONTEXT_FEATURES)}
    number = {c: k for k, c in enumerate(sorted(set(groups.values())))}
    if by_country and len(number) > 1:
        of = literal_map({c: str(number[g]) for c, g in groups.items()})
        home = p.where("src = 1").select(F.col("id").alias("i"), F.coalesce(F.element_at(of, F.col("country")), F.lit("-1")).cast("int").alias("fold"))
        other, _, _, _ = scored_by(x.drop("fold").join(home, "i"), tau)
        share = unseen_share(p, coming)
        report["loco"] = {n: metrics.score(universe, answer(other, rule), truth).first().macro_f for n, (_, rule) in cv.items()}
        report["unseen_share"] = share
        value = {n: (1 - share) * f + share * report["loco"][n] for n, f in value.items()}
    best = max(value, key=lambda n: (value[n], n))
    return Bundle(pruners, matchers, tau, cv[best][1], models.calibrator(scored), report | {"chosen": best}, words)


def pool_features(p: DataFrame, pool: DataFrame, bundle: Bundle) -> tuple[DataFrame, DataFrame]:
    """(all pairs with their prune score ``p``, kept pairs with all features that the matcher reads)."""
    first = cut(models.bagged(cut(pair_features(pool, p, label_groups(p))), PAIR_FEATURES, bundle.pruners))
    return first, cut(first.where(F.col("p") >= bundle.tau).withColumnRenamed("p", "p1").join(context_features(first, p), ["i", "j"]))


def score_pool(p: DataFrame, pool: DataFrame, bundle: Bundle) -> DataFrame:
    """(i, j, p1, p): prune and match scores; p is null for pruned pairs."""
    first, kept = pool_features(p, pool, bundle)
    second = models.bagged(kept, PAIR_FEATURES + CONTEXT_FEATURES, bundle.matchers).select("i", "j", "p")
    return first.select("i", "j", F.col("p").alias("p1")).join(second, ["i", "j"], "left")


def explainer(features: DataFrame, bundle: Bundle) -> Callable[[str], dict[str, dict]]:
    """For an entity, the attributions of its kept pairs by the other record's id. ``features`` as ``pool_features`` gives them."""
    names = PAIR_FEATURES + CONTEXT_FEATURES

    def explain(one: str) -> dict[str, dict]:
        return {r.j: models.attributions(bundle.matchers, names, r.asDict()) for r in features.where(F.col("i") == one).collect()}

    return explain


def predict(records: DataFrame, bundle: Bundle) -> tuple[DataFrame, DataFrame]:
    """(scored pairs with ``pc``, the calibrated score, and ``emitted``; universe)."""
    p = prepared(records, bundle.words)
    scored = cut(score_pool(p, cut(block(p)), bundle))
    kept = cut(models.apply_calibrator(scored.where("p IS NOT NULL"), bundle.calibrator))
    out = answer(kept, bundle.rule).withColumn("emitted", F.lit(True))
    return scored.join(kept.select("i", "j", "pc"), ["i", "j"], "left").join(out, ["i", "j"], "left").fillna(False, ["emitted"]), p.where("src = 1").select(F.col("id").alias("s1"))


@dataclass
class Store:
    """Scored records as new ones are resolved against them: every table is written once, none is computed again."""

    records: DataFrame
    postings: dict[str, DataFrame]
    frequencies: dict[str, DataFrame]
    reverse: dict[str, DataFrame]
    keys: DataFrame
    claims: DataFrame
    tables: dict[str, DataFrame]
    counts: DataFrame
    groups: dict[str, str]


def store(records: DataFrame, bundle: Bundle, *, k: int = retrieval.TOP) -> Store:
    """Blocks and scores the records and keeps what a new record is compared with."""
    p = prepared(records, bundle.words)
    made = {name: cut(retrieval.postings(x, **bounds)) for name, (x, bounds) in channel_terms(p).items()}
    n = F.lit(float(p.count()))
    freq = {name: cut(x.groupBy("term").agg(F.max("df_all").alias("df_all")).withColumn("n_docs", n)) for name, x in made.items()}
    reverse = {name: cut(retrieval.top_k(retrieval.cosine_best(x, 0, max(3, k // 4)), "j", "i", max(3, k // 4)).select("i", "j", "sim")) for name, x in made.items()}
    first, kept = pool_features(p, cut(block(p, k=k)), bundle)
    second = models.apply_calibrator(models.bagged(kept, PAIR_FEATURES + CONTEXT_FEATURES, bundle.matchers).select("i", "j", "p"), bundle.calibrator)
    claims = first.select("i", "j", F.col("p").alias("p1")).join(second, ["i", "j"], "left")
    others = {name: cut(x.where("src <> 1")) for name, x in made.items()}
    keys = cut(retrieval.block_keys(p.where("src <> 1").select("id", "src", record_keys().alias("keys"))))
    tables = {c: cut(idf(p, c)) for c in ("name_toks", "addr_toks")}
    return Store(p, others, freq, reverse, keys, cut(claims), tables, cut(name_counts(p)), label_groups(p))


def resolve(new: DataFrame, kept: Store, bundle: Bundle, *, k: int = retrieval.TOP, compete: bool = True) -> DataFrame:
    """(i, j, p1, p, pc, emitted) of new reference records against a store. Only what shares a term or key with them is read.

    With ``compete`` the stored claims on the same records count in context and exclusivity, as in a batch.
    """
    q = prepared(new.withColumn("src", F.lit(1)), bundle.words)
    rows = None
    for name, (terms, _) in channel_terms(q).items():
        mine = retrieval.weighted(terms, kept.frequencies[name])
        sims = cut(retrieval.cosine_best(mine.unionByName(kept.postings[name].join(mine.select("term").distinct(), "term", "left_semi").select(*mine.columns)), 1 << 30, 0))
        live = retrieval.live_query(sims, kept.reverse[name].join(sims.select("j").distinct(), "j", "left_semi"), k=k)
        part = live.withColumn("ch", F.when(F.col("ch") == "rev", f"{name}_rev").otherwise(name))
        rows = part if rows is None else rows.unionByName(part)
    asked = retrieval.block_keys(q.select("id", "src", record_keys().alias("keys")))
    pairs = retrieval.key_pairs(asked.unionByName(kept.keys.join(asked.select("key").distinct(), "key", "left_semi").select(*asked.columns)))
    rows = rows.unionByName(retrieval.top_k(pairs, "i", "j", k).select("i", "j", F.lit("keys").alias("ch"), "rank", "sim"))
    pool = cut(retrieval.fuse(rows, CHANNELS))
    met = pool.select("j").distinct()
    some = cut(q.unionByName(kept.records.where("src <> 1").join(met.withColumnRenamed("j", "id"), "id", "left_semi").select(*q.columns)))
    x = cut(models.bagged(cut(pair_features(pool, some, kept.groups, tables=kept.tables, counts=kept.counts)), PAIR_FEATURES, bundle.pruners))
    rivals = kept.claims.join(met, "j", "left_semi") if compete else kept.claims.limit(0)
    context_ = context_features(x.select("i", "j", "p").unionByName(rivals.select("i", "j", F.col("p1").alias("p"))), some)
    second = models.bagged(cut(x.where(F.col("p") >= bundle.tau).withColumnRenamed("p", "p1").join(context_, ["i", "j"])), PAIR_FEATURES + CONTEXT_FEATURES, bundle.matchers)
    scored = cut(models.apply_calibrator(second.select("i", "j", "p"), bundle.calibrator))
    claimed = scored.unionByName(rivals.where("p IS NOT NULL").select("i", "j", "p", "pc"))
    out = answer(claimed, bundle.rule).withColumn("emitted", F.lit(True))
    got = x.select("i", "j", F.col("p").alias("p1")).join(scored, ["i", "j"], "left").join(out, ["i", "j"], "left")
    return got.fillna(False, ["emitted"])
