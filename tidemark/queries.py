"""Registered queries of the recommender operators over the driver's tables, and their DuckDB SQL.

Interactions are order lines: user = customer, item = part, weight = quantity, datetime = ship date. Rows that tie in time
are ordered by order key and line number, then by item and weight.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scalar
from tidemark.functions.runtime import dense_index
from tidemark.operators import metrics as M
from tidemark.operators import models as O
from tidemark.operators.ann import ItemToItemAnnRecommender
from tidemark.operators.metrics.base import debias_interactions, merge_reco, outer_merge_reco
from tidemark.operators.models.sequential import masked_sessions, sessions
from tidemark.operators.rank import VectorRanker, recommend_from_scores, with_rank
from tidemark.operators.sampling import triplets
from tidemark.operators.splits import LastNSplitter, RandomSplitter, TimeRangeSplitter, get_not_seen, leave_one_out
from tidemark.plans.cross_validate import cross_validate_table
from tidemark.plans.metrics import calc_per_user, metric_table
from tidemark.plans.report import MetricsReport, ReportStorage
from tidemark.plans.two_stage import CandidateFeatureCollector, CandidateGenerator, CandidateRankingModel, PerUserNegativeSampler, Reranker
from tidemark.schema import Columns
from tidemark.sources.dataset import Dataset
from tidemark.sources.features import DenseFeatures, SparseFeatures
from tidemark.sources.idmap import IdMap
from tidemark.sources.interactions import get_context, user_item_matrix
from tidemark.streaming.popularity import run_once, windowed_popularity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Interactions as the SQL sides see them.
INTER = """inter as (select o_custkey as user_id, l_partkey as item_id, l_quantity as weight, l_shipdate as datetime, l_orderkey * 8 + l_linenumber as rid
  from lineitem join orders on l_orderkey = o_orderkey)"""
#: The fold of a seven-day split with all filters: train, test.
FOLD = (
    INTER
    + """, edge as (select date_trunc('day', max(datetime)) + interval 1 day as hi from inter),
train as (select inter.* from inter, edge where datetime < hi - interval 28 day),
raw_test as (select inter.* from inter, edge where datetime >= hi - interval 28 day and datetime < hi),
test as (select t.* from raw_test t where user_id in (select user_id from train) and item_id in (select item_id from train)
  and not exists (select 1 from train s where s.user_id = t.user_id and s.item_id = t.item_id)),
ranked as (select item_id, count(distinct user_id)::double as score, row_number() over (order by count(distinct user_id) desc, item_id) as pos from train group by item_id),
reco as (select user_id, item_id, score, rank from (select u.user_id, r.item_id, r.score, row_number() over (partition by u.user_id order by r.pos)::int as rank
  from (select distinct user_id from test) u, ranked r where not exists (select 1 from train s where s.user_id = u.user_id and s.item_id = r.item_id)) where rank <= 10)"""
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_custkey").alias(Columns.User), F.col("l_partkey").alias(Columns.Item), F.col("l_quantity").alias(Columns.Weight), F.col("l_shipdate").alias(Columns.Datetime),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(Columns.Row),
    )


def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(
        F.col("p_partkey").alias("id"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(c).cast("string").alias("value"), F.lit(i).alias("__o")) for i, (n, c) in enumerate((("size", "p_size"), ("brand", "p_brand"), ("type", "p_type")))])),
    ).select("id", "feature", "value", (F.col("id") * 8 + F.col("__o")).alias(Columns.Row))


def dataset(spark: SparkSession, sf_dir: str) -> Dataset:
    return Dataset.construct(interactions(spark, sf_dir), item_features_df=item_features(spark, sf_dir), cat_item_features=("brand", "type"))


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions with brand and type for the item: a catalog for models that hold a row or a square of it in memory."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), F.concat_ws("|", "p_brand", "p_type").alias("kind"))
    return interactions(spark, sf_dir).join(part, Columns.Item).select(Columns.User, F.col("kind").alias(Columns.Item), Columns.Weight, Columns.Datetime, Columns.Row)


SPLITTER = TimeRangeSplitter("28D")


def fold(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """train, test, reco: ten most popular items that a test user has not seen."""
    one = next(iter(SPLITTER.split(interactions(spark, sf_dir))))
    own = Dataset.construct(one.train)
    reco = O.PopularModel().fit(own).recommend(one.test.select(Columns.User), own, 10, True, on_unsupported_targets="ignore")
    return one.train, one.test, reco


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Sources and containers.


@query(f"with {INTER} select user_id, item_id, round(sum(weight), 6) as weight, count(*)::bigint as n from inter group by 1, 2")
def user_item_matrix_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = interactions(spark, sf_dir)
    both = user_item_matrix(df).join(user_item_matrix(df, include_weights=False).withColumnRenamed(Columns.Weight, "n"), Columns.UserItem)
    return both.select(*Columns.UserItem, F.round(Columns.Weight, 6).alias(Columns.Weight), F.col("n").cast("long").alias("n"))


@query(f"with {INTER} select item_id as external, row_number() over (order by min(rid), item_id) - 1 as internal from inter group by item_id")
def id_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return IdMap.from_values(interactions(spark, sf_dir), Columns.Item, Columns.Row).table


@query(
    f"""with {INTER}, hot as (select item_id as external, row_number() over (order by min(rid), item_id) - 1 as internal from inter where datetime < timestamp '1998-01-01' group by item_id),
    fresh as (select p_partkey as external, row_number() over (order by p_partkey) - 1 + (select count(*) from hot) as internal from part where p_partkey not in (select external from hot))
    select * from hot union all select * from fresh"""
)
def id_map_add_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = interactions(spark, sf_dir).where(F.col(Columns.Datetime) < F.lit("1998-01-01").cast("timestamp"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("row"))
    return IdMap.from_values(df, Columns.Item, Columns.Row).add_ids(parts, "p_partkey", "row").table


@query(
    f"""with {INTER}, u as (select user_id as e, row_number() over (order by min(rid), user_id) - 1 as n from inter group by 1),
    i as (select item_id as e, row_number() over (order by min(rid), item_id) - 1 as n from inter group by 1)
    select u.n as user_id, i.n as item_id, weight, datetime from inter join u on u.e = user_id join i on i.e = item_id"""
)
def interactions_internal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Dataset.construct(interactions(spark, sf_dir)).interactions.df.select(*Columns.Interactions)


@query(f"with {INTER} select user_id, item_id, weight from inter")
def interactions_to_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    return ds.interactions.to_external(ds.user_id_map, ds.item_id_map, include_datetime=False)


@query(
    f"""with {INTER} select (select count(*) from inter) as n_interactions, (select count(distinct user_id) from inter) as n_hot_users, (select count(distinct item_id) from inter) as n_hot_items,
    (select count(*) from (select item_id from inter union select p_partkey from part)) as n_items"""
)
def dataset_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = dataset(spark, sf_dir)
    counts = ds.raw.agg(F.count("*").alias("n_interactions"), F.countDistinct(Columns.User).alias("n_hot_users"), F.countDistinct(Columns.Item).alias("n_hot_items"))
    return counts.crossJoin(ds.item_id_map.table.agg(F.count("*").alias("n_items")))  # one row each


@query(
    f"""with {INTER}, kept as (select * from inter where rid % 2 = 0),
    u as (select user_id as e, row_number() over (order by min(rid), user_id) - 1 as n from kept group by 1)
    select u.n as user_id, e as external, count(*)::bigint as n from kept join u on e = user_id group by 1, 2"""
)
def filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    rows = ds.raw.where(F.col(Columns.Row) % 2 == 0).select(Columns.Row).distinct()
    own = ds.filter_interactions(rows)
    counts = own.raw.groupBy(F.col(Columns.User).alias("external")).agg(F.count("*").alias("n"))
    return counts.join(own.user_id_map.table, "external").select(F.col("internal").alias(Columns.User), "external", "n")


@query(f"with {INTER} select user_id, datetime, weight from (select *, row_number() over (partition by user_id order by datetime, rid, weight) as r from inter) where r = 1")
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = get_context(interactions(spark, sf_dir), order=[Columns.Row, Columns.Weight])
    return found.select(Columns.User, Columns.Datetime, Columns.Weight)


@query("select row_number() over (order by p_partkey) - 1 as id, p_size::double as size, round(p_retailprice, 2) as price from part")
def dense_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    ids = IdMap.from_values(part.withColumn("row", F.col("p_partkey")), "p_partkey", "row")
    features = DenseFeatures.from_dataframe(part.select(F.col("p_partkey").alias("id"), "p_size", "p_retailprice"), ids)
    return features.get_dense().select("id", F.col("values")[0].cast("double").alias("size"), F.round(F.col("values")[1].cast("double"), 2).alias("price"))


@query(
    """with rows as (select p_partkey as id, 'size' as feature, p_size::varchar as value, p_partkey * 8 as rid from part union all select p_partkey, 'brand', p_brand, p_partkey * 8 + 1 from part
      union all select p_partkey, 'type', p_type, p_partkey * 8 + 2 from part),
    keyed as (select id, feature, case when feature = 'size' then '__is_direct_feature' else value end as value, case when feature = 'size' then value::double else 1.0 end as x,
      case feature when 'brand' then 1 when 'type' then 2 else 0 end as block, rid from rows),
    names as (select feature, value, row_number() over (order by min(block), min(rid), feature, value) - 1 as col from keyed group by 1, 2)
    select n as id, col, names.feature, names.value, sum(x)::double as x from keyed join names using (feature, value) join (select p_partkey as id, row_number() over (order by p_partkey) - 1 as n from part) using (id) group by 1, 2, 3, 4"""
)
def sparse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_features(spark, sf_dir)
    ids = IdMap.from_values(rows, "id", Columns.Row)
    features = SparseFeatures.from_flatten(rows, ids, ("brand", "type"))
    return features.get_sparse().withColumnRenamed("value", "x").join(features.names, "col").select("id", "col", "feature", "value", "x")


@query("select distinct p_brand as value, 'brand' as feature from part union all select distinct p_type, 'type' from part")
def cat_feature_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = item_features(spark, sf_dir)
    features = SparseFeatures.from_flatten(rows, IdMap.from_values(rows, "id", Columns.Row), ("brand", "type"))
    return features.get_cat_features().names.select("value", "feature")


# Filters, set operations, splits.


@query(f"with {FOLD} select user_id, item_id, weight, datetime from raw_test t where not exists (select 1 from train s where s.user_id = t.user_id and s.item_id = t.item_id)")
def not_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = next(iter(TimeRangeSplitter("28D", filter_cold_users=False, filter_cold_items=False, filter_already_seen=False).split(interactions(spark, sf_dir))))
    return get_not_seen(one.train, one.test).select(*Columns.Interactions)


@query(f"with {INTER} select kind, count(*)::bigint as n from (select case when c_custkey in (select user_id from inter) then 'hot' else 'warm' end as kind from customer) group by 1")
def temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(Columns.User))
    ds = Dataset.construct(interactions(spark, sf_dir), user_features_df=users.select(Columns.User, F.lit("one").alias("feature"), F.lit("1").alias("value")))
    warm = ds.warm(Columns.User)
    assert warm is not None
    rows = ds.hot(Columns.User).withColumn("kind", F.lit("hot")).unionByName(warm.withColumn("kind", F.lit("warm")))
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


@query(f"with {INTER} select p_partkey as item_id, p_partkey in (select item_id from inter where weight > 49) as inside from part")
def isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item))
    heavy = interactions(spark, sf_dir).where(F.col(Columns.Weight) > 49)
    return scalar.isin(items, heavy, [Columns.Item]).withColumn("inside", F.lit(True)).unionByName(scalar.isin(items, heavy, [Columns.Item], invert=True).withColumn("inside", F.lit(False)))


@query(f"with {INTER} select distinct user_id, item_id from inter")
def unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scalar.unique_rows(interactions(spark, sf_dir).select(*Columns.UserItem))


@query(f"with {INTER} select rid, item_id - 1 as position from inter")
def element_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), (F.col("p_partkey") - 1).alias("position"))
    found = scalar.element_ids(interactions(spark, sf_dir).select(F.col(Columns.Row).alias("rid"), Columns.Item), places, Columns.Item, strict=False)
    return found.select("rid", "position")


@query("select p_partkey as item_id, round(ln(p_size + 1) / ln(3), 9) as x from part")
def log_at_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), F.round(scalar.log_at_base(F.col("p_size") + 1, 3), 9).alias("x"))


@query(
    f"""with {INTER}, edge as (select date_trunc('day', max(datetime)) + interval 1 day as hi from inter), folds as (select i, hi - to_days((2 - i) * 14) as lo, hi - to_days((1 - i) * 14) as up from edge, range(2) t(i)),
    tr as materialized (select distinct i, user_id, item_id from inter, folds where datetime < lo),
    te as materialized (select f.i, x.* from inter x, folds f where datetime >= lo and datetime < up)
    select i::int as i_split, user_id, item_id, weight, datetime from te semi join (select distinct i, user_id from tr) using (i, user_id) semi join (select distinct i, item_id from tr) using (i, item_id)
      anti join tr using (i, user_id, item_id)"""
)
def time_range_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = list(TimeRangeSplitter("14D", 2).split(interactions(spark, sf_dir)))
    parts = [f.test.select(F.lit(f.info[Columns.Split]).alias(Columns.Split), *Columns.Interactions) for f in folds]
    return parts[0].unionByName(parts[1])


@query(
    f"""with {FOLD} select 0 as i_split, (select count(*) from train) as train, (select count(distinct user_id) from train) as train_users, (select count(distinct item_id) from train) as train_items,
    (select count(*) from test) as test, (select count(distinct user_id) from test) as test_users, (select count(distinct item_id) from test) as test_items"""
)
def split_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(SPLITTER.split(interactions(spark, sf_dir)))).stats_table()


@query(
    f"""with {INTER}, r as (select *, row_number() over (partition by user_id order by datetime desc, rid desc, item_id desc, weight desc) as last from inter),
    tr as materialized (select distinct user_id, item_id from r where last > 3), te as materialized (select * from r where last <= 3)
    select user_id, item_id, weight, datetime from te semi join tr using (user_id) semi join (select distinct item_id from tr) using (item_id) anti join tr using (user_id, item_id)"""
)
def last_n_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(LastNSplitter(3).split(interactions(spark, sf_dir)))).test.select(*Columns.Interactions)


MD5 = "('0x' || substr(md5({}), 1, 15))::bigint"


@query(
    f"""with {INTER}, r as (select *, row_number() over (order by {MD5.format("concat_ws('|', 7, rid, user_id, item_id)")}, rid, user_id, item_id, weight) - 1 as place from inter),
    n as (select round_even(0.1 * count(*), 0)::bigint as n from inter), te as (select r.* from r, n where place < n), tr as (select r.* from r, n where place >= n)
    select user_id, item_id, weight, datetime from te where user_id in (select user_id from tr) and item_id in (select item_id from tr)
      and not exists (select 1 from tr where tr.user_id = te.user_id and tr.item_id = te.item_id)"""
)
def random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next(iter(RandomSplitter(0.1, random_state=7).split(interactions(spark, sf_dir)))).test.select(*Columns.Interactions)


@query(f"with {INTER} select user_id, item_id, weight, datetime from (select *, row_number() over (partition by user_id order by datetime desc, rid desc, item_id desc, weight desc) as r from inter) where r = 1")
def leave_one_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = interactions(spark, sf_dir)
    return leave_one_out(df.select(*Columns.UserItem, Columns.Weight, Columns.Datetime, Columns.Row)).select(*Columns.Interactions)


# Popularity models.


def _popular_sql(score: str) -> str:
    return f"""with {INTER}, ranked as (select item_id, {score} as score, row_number() over (order by {score} desc, item_id) as pos from inter group by item_id),
    top as (select * from ranked where pos <= 400), users as (select distinct user_id from inter),
    free as (select u.user_id, t.item_id, t.score, row_number() over (partition by u.user_id order by t.pos)::int as rank from users u, top t
      where not exists (select 1 from inter i where i.user_id = u.user_id and i.item_id = t.item_id))
    select user_id, item_id, round(score, 3) as score, rank from free where rank <= 10"""


def _popular(popularity: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = Dataset.construct(interactions(spark, sf_dir))
        reco = O.PopularModel(popularity).fit(ds).recommend(ds.hot(Columns.User), ds, 10, True, on_unsupported_targets="ignore")
        return reco.withColumn(Columns.Score, F.round(F.col(Columns.Score).cast("double"), 3))

    return run


for _name, _score in (("n_users", "count(distinct user_id)::double"), ("n_interactions", "count(*)::double"), ("sum_weight", "sum(weight)")):
    QUERIES[f"popular_{_name}"] = _popular(_name)
    SQL[f"popular_{_name}"] = _popular_sql(_score)


@query(
    f"""with {INTER}, old as (select inter.* from inter, (select max(datetime) as m from inter) where datetime >= m - interval 60 day),
    s as (select p_partkey as item_id, coalesce(n, 0)::double as score from (select p_partkey from part where p_partkey in (select item_id from inter)) left join (select item_id as i, avg(weight) as n from old group by 1) on p_partkey = i)
    select u.user_id, item_id, round(score, 3) as score, rank from (select distinct user_id from inter) u, (select *, row_number() over (order by score, item_id desc)::int as rank from s) where rank <= 5"""
)
def popular_inverse_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import timedelta

    ds = Dataset.construct(interactions(spark, sf_dir))
    model = O.PopularModel("mean_weight", period=timedelta(days=60), add_cold=True, inverse=True).fit(ds)
    reco = model.recommend(ds.hot(Columns.User), ds, 5, False, on_unsupported_targets="ignore")
    return reco.withColumn(Columns.Score, F.round(F.col(Columns.Score).cast("double"), 3))


@query(f"with {FOLD} select round(avg(tp / n), 9) as recall from (select t.user_id, count(r.rank)::double as tp, count(*) as n from test t left join reco r on t.user_id = r.user_id and t.item_id = r.item_id group by 1)")
def popular_recall_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    return metric_table({"recall": M.Recall(10)}, reco, test).select(F.round("value", 9).alias("recall"))


@query(f"with {FOLD} select user_id, item_id, score, rank from reco")
def popular_fold_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold(spark, sf_dir)[2].withColumn(Columns.Score, F.col(Columns.Score).cast("double"))


CATEGORY_SQL = f"""with {INTER}, rows as (select inter.*, p_type as category from inter join part on p_partkey = item_id),
cats as (select category, count(distinct user_id) as total, row_number() over (order by count(distinct user_id) desc, category) - 1 as priority from rows group by 1),
floors as (select *, floor(12 * total / (select sum(total) from cats) + 1e-12)::int as f from cats),
quota as (select category, priority, f + (priority < 12 - (select sum(f) from floors))::int as quota from floors),
lists as (select category, item_id, count(distinct user_id)::double as score from rows group by 1, 2),
listed as (select *, row_number() over (partition by category order by score desc, item_id) as place from lists),
top as (select * from listed where place <= 200),
free as (select u.user_id, t.category, t.item_id, t.score, q.priority, q.quota, row_number() over (partition by u.user_id, t.category order by t.place) - 1 as cr
  from (select distinct user_id from inter) u, top t join quota q using (category) where not exists (select 1 from inter i where i.user_id = u.user_id and i.item_id = t.item_id)),
main as (select * from free where cr < quota),
final as (select *, row_number() over (partition by user_id, priority order by cr) as nr from main)
select user_id, item_id, score, row_number() over (partition by user_id order by {{}})::int as rank from final"""


def _category(mixing: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = Dataset.construct(interactions(spark, sf_dir), item_features_df=item_features(spark, sf_dir).where("feature = 'type'"), cat_item_features=("type",))
        reco = O.PopularInCategoryModel("type", mixing_strategy=mixing).fit(ds).recommend(ds.hot(Columns.User), ds, 12, True, on_unsupported_targets="ignore")
        return reco.withColumn(Columns.Score, F.col(Columns.Score).cast("double"))

    return run


# With at least one place a category and long lists, no fallback row is needed, so the SQL has none.
for _name, _order in (("rotate", "nr, priority"), ("group", "priority, cr")):
    QUERIES[f"popular_in_category_{_name}"] = _category(_name)
    SQL[f"popular_in_category_{_name}"] = CATEGORY_SQL.format(_order)


@query(
    f"""with {INTER}, pool as (select item_id, row_number() over (order by item_id) as place from (select distinct item_id from inter)), n as (select count(*) as n from pool),
    p as (select n, min(x) as p from n, lateral (select unnest(range(n, 2 * n + 3)) as x) where x > 1 and not list_bool_or(list_transform(range(2, sqrt(x)::bigint + 1), lambda d: x % d = 0 and d < x)) group by n),
    own as (select user_id, n, p, {MD5.format("concat_ws('|', 1, 0, 'a', user_id)")} % (p - 1) + 1 as a, {MD5.format("concat_ws('|', 1, 0, 'b', user_id)")} % p as b from (select distinct user_id from inter), p),
    drawn as (select user_id, n, i, (i * a + b) % p + 1 as place from own, lateral (select unnest(range(p)) as i)),
    free as (select d.user_id, item_id, row_number() over (partition by d.user_id order by i) as rank from drawn d join pool using (place) anti join inter s on s.user_id = d.user_id and s.item_id = pool.item_id),
    kept as (select * from free where rank <= 10)
    select user_id, item_id, (count(*) over (partition by user_id) - rank + 1)::float as score, rank::int as rank from kept"""
)
def random_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    return O.RandomModel(random_state=1).fit(ds).recommend(ds.hot(Columns.User), ds, 10, True, on_unsupported_targets="ignore")


# Neighbours and linear models.


def _knn_sql(weighting: str) -> str:
    cells = {
        "plain": "select user_id, item_id, x as w from m",
        "cosine": "select user_id, item_id, x / n as w from m join (select item_id, sqrt(sum(x * x)) as n from m group by 1) using (item_id)",
        "tfidf": "select user_id, item_id, v / n as w from v join (select item_id, sqrt(sum(v * v)) as n from v group by 1) using (item_id)",
        "bm25": "select user_id, item_id, v as w from v",
    }[weighting]
    value = "sqrt(x) * idf" if weighting == "tfidf" else "x * 2.2 / (1.2 * (0.25 + 0.75 * s / ms) + x) * idf"
    return f"""with {INTER}, m as (select user_id, item_id, sum(weight) as x from inter group by 1, 2),
    u as (select user_id, ln((select count(distinct item_id) from m)) - ln(1 + count(*)) as idf from m group by 1), i as (select item_id, sum(x) as s from m group by 1), a as (select avg(s) as ms from i),
    v as (select user_id, item_id, {value} as v from m join u using (user_id) join i using (item_id), a), c as ({cells}),
    s as (select a.item_id as t, b.item_id as item_id, sum(a.w * b.w) as s from c a join c b using (user_id) group by 1, 2),
    k as (select * from (select *, row_number() over (partition by t order by round(s, 12) desc, item_id desc) as r from s) where r <= 20)"""


def _knn_reco_sql(weighting: str) -> str:
    return (
        _knn_sql(weighting)
        + """, r as (select m.user_id, k.item_id, round(sum(m.x * round(k.s, 12)), 9) as score from m join k on m.item_id = k.t group by 1, 2),
    f as (select * from r where score <> 0 and not exists (select 1 from m where m.user_id = r.user_id and m.item_id = r.item_id))
    select user_id, item_id, rank, round(score::float::double, 4) as score from (select *, row_number() over (partition by user_id order by score desc, item_id)::int as rank from f) where rank <= 10"""
    )


def _knn(weighting: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = Dataset.construct(interactions(spark, sf_dir))
        reco = O.ItemKNNModel(weighting, K=20).fit(ds).recommend(ds.hot(Columns.User), ds, 10, True, on_unsupported_targets="ignore")
        return reco.select(*Columns.UserItem, Columns.Rank, F.round(F.col(Columns.Score).cast("double"), 4).alias(Columns.Score))

    return run


for _name in ("plain", "cosine", "tfidf", "bm25"):
    QUERIES[f"item_knn_{_name}"] = _knn(_name)
    SQL[f"item_knn_{_name}"] = _knn_reco_sql(_name)


@query(
    _knn_sql("tfidf")
    + """ select t as target_item_id, item_id, r::int as rank, round(s::float::double, 6) as score from (select t, item_id, round(s, 12) as s, row_number() over (partition by t order by round(s, 12) desc, item_id) as r from k where t <> item_id)
    where r <= 5"""
)
def item_knn_i2i(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    reco = O.ItemKNNModel("tfidf", K=20).fit(ds).recommend_to_items(ds.hot(Columns.Item), ds, 5, on_unsupported_targets="ignore")
    return reco.select(Columns.TargetItem, Columns.Item, Columns.Rank, F.round(F.col(Columns.Score).cast("double"), 6).alias(Columns.Score))


@query(_knn_sql("cosine") + " select t as target_item_id, item_id, row_number() over (partition by t order by round(s, 12) desc, item_id)::int as rank, round(s, 6) as score from k")
def item_knn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    model = O.ItemKNNModel("cosine", K=20).fit(ds)
    return with_rank(model.tables["similar"], Columns.TargetItem).select(Columns.TargetItem, Columns.Item, Columns.Rank, F.round(Columns.Score, 6).alias(Columns.Score))


def _fitted(make: Callable[[], O.ModelBase], rows: Callable[[SparkSession, str], DataFrame] = interactions) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = Dataset.construct(rows(spark, sf_dir))
        return make().fit(ds).recommend(ds.hot(Columns.User), ds, 10, False, on_unsupported_targets="ignore")

    return run


QUERIES["ease"] = _fitted(lambda: O.EASEModel(500.0), coarse)
QUERIES["pure_svd"] = _fitted(lambda: O.PureSVDModel(16, random_state=1))
QUERIES["als"] = _fitted(lambda: O.ALSModel(16, iterations=3, random_state=1))
QUERIES["bpr"] = _fitted(lambda: O.BPRModel(16, iterations=2, learning_rate=0.05, random_state=1))
QUERIES["lightfm"] = _fitted(lambda: O.LightFMModel(16, loss="warp", epochs=2, random_state=1))


def _sequence(make: Callable[[], O.ModelBase]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ds = Dataset.construct(interactions(spark, sf_dir))
        now = get_context(ds.raw.withColumn(Columns.Datetime, F.col(Columns.Datetime) + F.expr("interval 10 years")))
        return make().fit(ds).recommend(ds.hot(Columns.User), ds, 10, False, on_unsupported_targets="ignore", context=now)

    return run


_SMALL = {"n_factors": 16, "n_blocks": 1, "n_heads": 2, "session_max_len": 20, "epochs": 1, "loss": "sampled_softmax", "n_negatives": 16}
QUERIES["sasrec"] = _sequence(lambda: O.SASRecModel(**_SMALL))
QUERIES["bert4rec"] = _sequence(lambda: O.BERT4RecModel(**_SMALL))
QUERIES["hstu"] = _sequence(lambda: O.HSTUModel(**_SMALL))
QUERIES["ligr"] = _sequence(lambda: O.LiGRModel(**_SMALL | {"loss": "gBCE", "n_negatives": 4}))


@query()
def dssm(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit("segment").alias("feature"), F.col("c_mktsegment").alias("value"))
    ds = Dataset.construct(interactions(spark, sf_dir), users, ("segment",), item_features_df=item_features(spark, sf_dir).where("feature <> 'size'"), cat_item_features=("brand", "type"))
    return O.DSSMModel(16, max_epochs=1, batch_size=512).fit(ds).recommend(ds.hot(Columns.User), ds, 10, False, on_unsupported_targets="ignore")


@query(
    f"""with {INTER}, last as (select *, row_number() over (partition by user_id order by datetime desc, rid desc, item_id desc, weight desc) as r from inter)
    select user_id, string_agg(item_id, ',' order by r desc) as items, count(*)::bigint as n from last where r <= 20 group by 1 having count(*) >= 2"""
)
def session_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions(interactions(spark, sf_dir), 20, 2)
    return found.select(Columns.User, F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query(
    f"""with {INTER}, last as (select *, row_number() over (partition by user_id order by datetime desc, rid desc, item_id desc, weight desc) as r from inter),
    s as (select user_id, item_id, row_number() over (partition by user_id order by r desc) - 1 as i from last where r <= 20),
    d as (select *, {MD5.format("concat_ws('|', 5, user_id, i)")} % 1000000 / 1000000.0 as u, {MD5.format("concat_ws('|', 5, 'item', user_id, i)")} % 100 + 2 as other from s)
    select user_id, string_agg(case when u >= 0.15 then item_id when u < 0.12 then 1 when u < 0.135 then other else item_id end, ',' order by i) as x,
    string_agg(case when u < 0.15 then item_id else 0 end, ',' order by i) as y from d group by 1"""
)
def masked_session_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = masked_sessions(sessions(interactions(spark, sf_dir), 20), 100, 0.15, 5)
    return found.select(Columns.User, *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("x", "y")])


# Rankers over vectors.


def _rank_sql(distance: str) -> str:
    score = {"dot": "sum(a.x * b.x)", "cosine": "sum(a.x * b.x) / (any_value(a.n) * any_value(b.n))", "euclidean": "sqrt(sum((a.x - b.x) * (a.x - b.x)))"}[distance]
    best = "asc" if distance == "euclidean" else "desc"
    return f"""with e as (select vec_id, unnest(range(len(embedding))) as i, unnest(embedding)::double as x, sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) as n from embeddings),
    s as (select a.vec_id as subject, b.vec_id as object, {score} as score from e a join e b using (i) where a.vec_id <> b.vec_id group by 1, 2)
    select subject, object, rank, round(score, 6) as score from (select *, row_number() over (partition by subject order by round(score, 12) {best}, object)::int as rank from s) where rank <= 10"""


def _ranker(distance: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("factors"))
        reco = VectorRanker(distance, vectors, vectors).rank(10, exclude_self=True, as_float=False)
        return reco.select("subject", "object", "rank", F.round("score", 6).alias("score"))

    return run


for _name in ("dot", "cosine", "euclidean"):
    QUERIES[f"rank_{_name}"] = _ranker(_name)
    SQL[f"rank_{_name}"] = _rank_sql(_name)


@query(
    _rank_sql("cosine").split("select subject, object, rank, round")[0].replace(" where a.vec_id <> b.vec_id", "").rstrip()
    + """, near as (select subject, object, row_number() over (partition by subject order by round(score, 12) desc, object) as r from s)
    select subject as target, row_number() over (partition by subject order by r)::int as rank, object as item_id from near where r <= 16 and object % 2 = 1 and subject % 2 = 0 qualify rank <= 5"""
)
def ann_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of the even vectors among the odd ones, out of the nearest sixteen."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("factors"))
    even, odd = vectors.where("id % 2 = 0").select("id"), vectors.where("id % 2 = 1").select(F.col("id").alias("item_id"))
    # All odd vectors are available to every even one: lists of the nearest are cut by parity, without a table of pairs.
    nearest = ItemToItemAnnRecommender(vectors, index_top_k=11)
    found = nearest._nearest(vectors.join(even, "id", "left_semi"), 5)
    return nearest._truncate(found.join(odd, "item_id", "left_semi"), 5).select("target", "rank", "item_id")


@query(
    f"""with {INTER}, m as (select user_id, item_id, sum(weight) as w from inter group by 1, 2), d as (select *, -ln(({MD5.format("concat_ws('|', 3, user_id, item_id)")} + 1) / 1152921504606846976.0::double) / w as key from m),
    p as (select user_id, item_id as positive, row_number() over (partition by user_id order by key, item_id) as r from d),
    c as (select item_id, row_number() over (order by min(rid), item_id) - 1 as i from inter group by 1)
    select user_id, positive, c.item_id as negative from p join c on c.i = {MD5.format("concat_ws('|', 3, 'negative', user_id)")} % (select count(*) from c) where r = 1"""
)
def dssm_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triplets(Dataset.construct(interactions(spark, sf_dir)), 3)


@query(f"with {INTER} select item_id, round(sum(weight), 3) as score from inter where item_id % 3 <> 0 group by item_id order by sum(weight) desc, item_id limit 20")
def recommend_from_scores_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = interactions(spark, sf_dir).groupBy(Columns.Item).agg(F.sum(Columns.Weight).alias(Columns.Score))
    blocked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item)).where(F.col(Columns.Item) % 3 == 0)
    return recommend_from_scores(scores, 20, blacklist=blocked).withColumn(Columns.Score, F.round(Columns.Score, 3))


# Metrics.

MERGED = ", merged as (select t.user_id, t.item_id, r.rank from test t left join reco r on t.user_id = r.user_id and t.item_id = r.item_id), catalog as (select count(distinct item_id)::double as n from train)"
CONFUSION = MERGED + ", conf as (select user_id, count(case when rank <= 5 then 1 end)::double as tp, count(*)::double as liked from merged group by 1)"


@query(
    f"""with {FOLD}{CONFUSION}, c as (select user_id, tp, liked, 5 - tp as fp, liked - tp as fn, n - 5 - (liked - tp) as tn, n from conf, catalog)
    select user_id, round(tp / 5, 9) as "precision", round(tp / least(5.0, liked), 9) as r_precision, round(tp / liked, 9) as recall,
    round(case when tp > 0 then 3 * (tp / 5) * (tp / liked) / (2 * tp / 5 + tp / liked) else 0 end, 9) as f1, round((tp + tn) / n, 9) as accuracy, (tp > 0)::double as hit_rate,
    round(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end, 9) as mcc from c"""
)
def classification_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, reco = fold(spark, sf_dir)
    kinds = {
        "precision": M.Precision(5), "r_precision": M.Precision(5, r_precision=True), "recall": M.Recall(5), "f1": M.F1Beta(5, beta=2**0.5), "accuracy": M.Accuracy(5), "hit_rate": M.HitRate(5), "mcc": M.MCC(5),
    }
    found = calc_per_user(kinds, reco, test, catalog=train.select(Columns.Item))
    return found.select(Columns.User, *[F.round(c, 9).alias(c) for c in kinds])


@query(
    f"""with {FOLD}{MERGED}, cnt as (select user_id, rank, count(*) as c from merged where rank <= 10 group by 1, 2), run as (select *, sum(c) over (partition by user_id order by rank) as s from cnt),
    n as (select user_id, count(*)::double as n from merged group by 1),
    v as (select user_id, sum(s / rank) as ap, sum(c / log2(rank + 1)) as dcg, min(rank) as mr from run group by 1),
    ideal as (select sum(1 / log2(r + 1)) as all_, list(sum(1 / log2(r + 1)) order by r) as l from range(1, 11) t(r) group by ())
    select user_id, round(coalesce(ap, 0) / n, 9) as map, round(coalesce(ap, 0) / 10, 9) as map_k, round(coalesce(dcg, 0) / (select sum(1 / log2(r + 1)) from range(1, 11) t(r)), 9) as ndcg,
    round(coalesce(dcg, 0) / (select sum(1 / log2(r + 1)) from range(1, 11) t(r) where r <= n.n), 9) as ndcg_achievable, round(coalesce(1.0 / mr, 0), 9) as mrr from n left join v using (user_id)""".replace(
        """,
    ideal as (select sum(1 / log2(r + 1)) as all_, list(sum(1 / log2(r + 1)) order by r) as l from range(1, 11) t(r) group by ())""", ""
    )
)
def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    kinds = {"map": M.MAP(10), "map_k": M.MAP(10, divide_by_k=True), "ndcg": M.NDCG(10), "ndcg_achievable": M.NDCG(10, divide_by_achievable=True), "mrr": M.MRR(10)}
    found = calc_per_user(kinds, reco, test)
    return found.select(Columns.User, *[F.round(c, 9).alias(c) for c in kinds])


@query(
    f"""with {FOLD}, pos as (select distinct user_id, item_id from test), own as (select r.* from reco r where user_id in (select user_id from pos)),
    h as (select p.user_id, o.rank, row_number() over (partition by p.user_id order by o.rank) as i from pos p join own o on p.user_id = o.user_id and p.item_id = o.item_id),
    n as (select user_id, count(*) as n from pos group by 1),
    v as (select user_id, sum(case when rank - i < 3 then 3 - (rank - i) else 0 end) as a, sum(case when rank - i < 3 and i <= 3 then 3 - (rank - i) else 0 end) as b from h group by 1)
    select user_id, round(coalesce(a, 0) / (3.0 * n), 9) as pauc, round(coalesce(b, 0) / (3.0 * least(n, 3)), 9) as pap from n left join v using (user_id)"""
)
def auc_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    found = calc_per_user({"pauc": M.PartialAUC(3), "pap": M.PAP(3)}, reco, test)
    return found.select(Columns.User, F.round("pauc", 9).alias("pauc"), F.round("pap", 9).alias("pap"))


@query(
    f"""with {FOLD}, pop as (select item_id, count(*) as c, count(distinct user_id) as u from train group by 1), lev as (select c, row_number() over (order by c desc) as r from (select distinct c from pop)),
    tot as (select count(*) as t, count(distinct user_id) as nu, count(distinct item_id)::double as ni from train),
    e as (select r.*, p.c, p.u, l.r as pr, t, nu, ni, (select count(*) from test s where s.user_id = r.user_id and s.item_id = r.item_id) as rel from reco r left join pop p using (item_id) left join lev l using (c), tot)
    select user_id, round(avg(case when rank <= 7 then -log2(coalesce(u, 1)::double / nu) end), 9) as miuf, round(avg(case when rank <= 7 then coalesce(c, 0) end), 9) as arp,
    round(avg(case when rank <= 7 then coalesce(c, 0)::double / t end), 9) as arp_share,
    round(sum(case when rank <= 7 then greatest((ni + 1 - rank) / ni - coalesce((ni + 1 - pr) / ni, 0), 0) * rel else 0 end) / 7, 9) as serendipity,
    (count(case when rank <= 7 then 1 end) >= 7)::double as sufficient, (count(case when rank <= 7 then 1 end) = count(distinct case when rank <= 7 then item_id end))::double as unrepeated from e group by 1"""
)
def beyond_accuracy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, reco = fold(spark, sf_dir)
    kinds = {
        "miuf": M.MeanInvUserFreq(7), "arp": M.AvgRecPopularity(7), "arp_share": M.AvgRecPopularity(7, normalize=True), "serendipity": M.Serendipity(7), "sufficient": M.SufficientReco(7), "unrepeated": M.UnrepeatedReco(7),
    }
    found = calc_per_user(kinds, reco, test, train, train.select(Columns.Item))
    return found.select(Columns.User, *[F.round(c, 9).alias(c) for c in kinds])


ILD_SQL = f"""with {FOLD}, f as (select p_partkey, p_brand as a, p_type as b, p_size as c from part), top as (select * from reco where rank <= 6),
pairs as (select x.user_id, (f.a <> g.a)::int + (f.b <> g.b)::int + (f.c <> g.c)::int as d from top x join top y on x.user_id = y.user_id and x.rank < y.rank join f on f.p_partkey = x.item_id join f g on g.p_partkey = y.item_id)"""


@query(ILD_SQL + " select u.user_id, round(coalesce(avg(d), 0), 9) as ild from (select distinct user_id from top) u left join pairs using (user_id) group by 1")
def intra_list_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reco = fold(spark, sf_dir)[2]
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), "p_brand", "p_type", "p_size")
    found = calc_per_user({"ild": M.IntraListDiversity(6, M.PairwiseHammingDistanceCalculator(part))}, reco)
    return found.select(Columns.User, F.round("ild", 9).alias("ild"))


@query(ILD_SQL.replace("(f.c <> g.c)::int", "0") + " select u.user_id, round(2 * coalesce(avg(d), 0), 9) as ild from (select distinct user_id from top) u left join pairs using (user_id) group by 1")
def sparse_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two items of different brands differ in two cells of the sparse brand columns."""
    reco = fold(spark, sf_dir)[2]
    rows = item_features(spark, sf_dir)
    ids = IdMap.from_values(rows, "id", Columns.Row)
    features = SparseFeatures.from_flatten(rows.where("feature <> 'size'"), ids, ("brand", "type"))
    found = calc_per_user({"ild": M.IntraListDiversity(6, M.SparsePairwiseHammingDistanceCalculator(features, ids))}, reco)
    return found.select(Columns.User, F.round("ild", 9).alias("ild"))


@query(
    f"""with {FOLD} select 'covered' as metric, round(avg((r.user_id is not null)::double), 9) as value from (select distinct user_id from test) t left join (select distinct user_id from reco where rank <= 3) r using (user_id)
    union all select 'coverage', round(count(distinct item_id) / (select count(distinct item_id)::double from train), 9) from reco where rank <= 3
    union all select 'coverage_n', count(distinct item_id)::double from reco where rank <= 3"""
)
def coverage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, reco = fold(spark, sf_dir)
    kinds = {"covered": M.CoveredUsers(3), "coverage": M.CatalogCoverage(3, normalize=True), "coverage_n": M.CatalogCoverage(3)}
    return metric_table(kinds, reco, test, catalog=train.select(Columns.Item)).select("metric", F.round("value", 9).alias("value"))


@query(
    f"""with {FOLD}, other as (select user_id, item_id, rank from (select u.user_id, r.item_id, row_number() over (partition by u.user_id order by s desc, r.item_id) as rank from (select distinct user_id from test) u,
      (select item_id, sum(weight) as s from train group by 1 order by s desc, item_id limit 20) r) where rank <= 10)
    select 'same_ref' as metric, round(avg(tp / n), 9) as value from (select r.user_id, count(o.rank)::double as tp, count(*) as n from reco r left join other o on o.user_id = r.user_id and o.item_id = r.item_id where r.rank <= 5 group by 1)"""
)
def intersection_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test, reco = fold(spark, sf_dir)
    own = Dataset.construct(train)
    ref = O.PopularModel("sum_weight").fit(own).recommend(test.select(Columns.User), own, 10, False, on_unsupported_targets="ignore")
    return metric_table({"same": M.Intersection(5, ref_k=10)}, reco, ref_reco={"ref": ref}).select("metric", F.round("value", 9).alias("value"))


@query(f"with {FOLD} select t.user_id, t.item_id, coalesce(r.rank, 0)::int as rank from test t left join reco r on t.user_id = r.user_id and t.item_id = r.item_id")
def merged_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    return merge_reco(reco, test).withColumn(Columns.Rank, F.coalesce(Columns.Rank, F.lit(0)))


@query(
    f"""with {FOLD}, pos as (select distinct user_id, item_id from test), own as (select * from reco where rank % 2 = 0), a as (select coalesce(p.user_id, o.user_id) as user_id, coalesce(p.item_id, o.item_id) as item_id, o.rank,
      p.user_id is not null as positive from pos p full outer join own o on p.user_id = o.user_id and p.item_id = o.item_id),
    g as (select user_id, unnest(range(1, max(rank) + 1)) as rank from own group by 1)
    select coalesce(a.user_id, g.user_id) as user_id, coalesce(a.item_id, -1) as item_id, coalesce(a.rank, g.rank, 0)::int as rank, coalesce(a.positive, false) as positive from a full outer join g on a.user_id = g.user_id and a.rank = g.rank"""
)
def outer_merged_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    found = outer_merge_reco(reco.where(F.col(Columns.Rank) % 2 == 0), test)
    return found.select(Columns.User, F.coalesce(Columns.Item, F.lit(-1)).alias(Columns.Item), F.coalesce(F.col(Columns.Rank).cast("int"), F.lit(0)).alias(Columns.Rank), F.col("__test_positive").alias("positive"))


@query(
    """with e as (select user_id, event_type as item_id from events), n as (select item_id, count(distinct user_id) as n from e group by 1),
    b as (select floor(quantile_cont(n, 0.75) + 0 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))) as border from n)
    select e.item_id, least(count(*), case when any_value(n.n) > any_value(border) then any_value(border) else count(*) end)::bigint as kept from e join n using (item_id), b group by 1"""
)
def debias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(Columns.User, F.col("event_type").alias(Columns.Item), F.col("event_id"))
    kept = debias_interactions(rows, M.DebiasConfig(iqr_coef=0.0, random_state=1))
    return kept.groupBy(Columns.Item).agg(F.count("*").alias("kept"))


@query(
    f"""with {FOLD}, n as (select item_id, count(distinct user_id) as n from test group by 1), b as (select floor(quantile_cont(n, 0.75) + 0.5 * (quantile_cont(n, 0.75) - quantile_cont(n, 0.25))) as border from n),
    k as (select t.*, n.n, border, row_number() over (partition by item_id order by {MD5.format("concat_ws('|', 3, t.user_id, t.item_id)")}, t.user_id, t.weight, t.datetime, t.rid) as r from test t join n using (item_id), b),
    d as (select * from k where n <= border or r <= border)
    select round(avg(tp / n), 9) as recall from (select t.user_id, count(r.rank)::double as tp, count(*) as n from d t left join reco r on t.user_id = r.user_id and t.item_id = r.item_id group by 1)"""
)
def debiased_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, test, reco = fold(spark, sf_dir)
    return metric_table({"recall": M.Recall(10, debias_config=M.DebiasConfig(0.5, 3))}, reco, test).select(F.round("value", 9).alias("recall"))


def _all_metrics_sql() -> str:
    """Every metric at 1, 5 and 10: a table a family with a row a k, then one row a metric."""
    gain = "(select sum(1 / log2(r + 1)) from range(1, 11) t(r) where r <= k)"
    families = {
        "cls": ("prec", "recall", "f1", "acc", "mcc", "hit"), "rk": ("map", "ndcg", "mrr"), "auc": ("pauc", "pap"), "byd": ("miuf", "arp", "ser", "suff", "unrep"), "cat": ("cov",), "usr": ("users",),
    }
    rows = [f"select '{n}@' || k as metric, round({n}::double, 6) as value from {t}" for t, names in families.items() for n in names]
    return f"""with {FOLD}{MERGED}, ks(k) as (values (1), (5), (10)),
    conf as (select k, user_id, count(case when rank <= k then 1 end)::double as tp, count(*)::double as liked from merged, ks group by 1, 2),
    c as (select *, k - tp as fp, liked - tp as fn, n - k - (liked - tp) as tn from conf, catalog),
    cls as (select k, avg(tp / k) as prec, avg(tp / liked) as recall, avg(case when tp > 0 then 2 * (tp / k) * (tp / liked) / (tp / k + tp / liked) else 0 end) as f1, avg((tp + tn) / n) as acc, avg((tp > 0)::double) as hit,
      avg(case when (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) <> 0 then (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) else 0 end) as mcc from c group by 1),
    cnt as (select user_id, rank, count(*) as c from merged where rank is not null group by 1, 2), run as (select *, sum(c) over (partition by user_id order by rank) as s from cnt),
    liked as (select user_id, count(*)::double as n from merged group by 1),
    v as (select k, user_id, sum(s / rank) as ap, sum(c / log2(rank + 1)) as dcg, min(rank) as mr from run, ks where rank <= k group by 1, 2),
    rk as (select k, avg(coalesce(ap, 0) / n) as map, avg(coalesce(dcg, 0)) / {gain} as ndcg, avg(coalesce(1.0 / mr, 0)) as mrr from (select * from liked, ks) left join v using (k, user_id) group by 1),
    pos as (select distinct user_id, item_id from test),
    h as (select p.user_id, o.rank, row_number() over (partition by p.user_id order by o.rank) as i from pos p join reco o on p.user_id = o.user_id and p.item_id = o.item_id),
    a as (select k, user_id, sum(case when rank - i < k then k - (rank - i) else 0 end) as a, sum(case when rank - i < k and i <= k then k - (rank - i) else 0 end) as b from h, ks group by 1, 2),
    auc as (select k, avg(coalesce(a, 0) / (k * n)) as pauc, avg(coalesce(b, 0) / (k * least(n, k))) as pap from (select * from (select user_id, count(*)::double as n from pos group by 1), ks) left join a using (k, user_id) group by 1),
    pop as (select item_id, count(*) as c, count(distinct user_id) as u from train group by 1), lev as (select c, row_number() over (order by c desc) as r from (select distinct c from pop)),
    tot as (select count(distinct user_id) as nu, count(distinct item_id)::double as ni from train),
    e as (select r.user_id, r.item_id, r.rank, p.c, p.u, l.r as pr, nu, ni, (t.user_id is not null)::int as rel from reco r left join pop p using (item_id) left join lev l using (c) left join pos t on t.user_id = r.user_id and t.item_id = r.item_id, tot),
    each as (select k, user_id, avg(-log2(coalesce(u, 1)::double / nu)) as miuf, avg(coalesce(c, 0)) as arp, sum(greatest((ni + 1 - rank) / ni - coalesce((ni + 1 - pr) / ni, 0), 0) * rel) / k as ser,
      (count(*) >= k)::double as suff, (count(*) = count(distinct item_id))::double as unrep from e, ks where rank <= k group by 1, 2),
    byd as (select k, avg(miuf) as miuf, avg(arp) as arp, avg(ser) as ser, avg(suff) as suff, avg(unrep) as unrep from each group by 1),
    cat as (select k, count(distinct item_id) as cov from reco, ks where rank <= k group by 1),
    usr as (select k, avg((r.user_id is not null)::double) as users from (select * from (select distinct user_id from test), ks) t left join (select distinct user_id, k from reco, ks where rank <= k) r using (k, user_id) group by 1),
    f as (select p_partkey, p_brand as a, p_type as b, p_size as c from part),
    pairs as (select x.user_id, (f.a <> g.a)::int + (f.b <> g.b)::int + (f.c <> g.c)::int as d from reco x join reco y on x.user_id = y.user_id and x.rank < y.rank join f on f.p_partkey = x.item_id join f g on g.p_partkey = y.item_id)
    {' union all '.join(rows)}
    union all select 'ild@10', round(avg(ild), 6) from (select u.user_id, coalesce(avg(d), 0) as ild from (select distinct user_id from reco) u left join pairs using (user_id) group by 1)
    union all select 'same@10', round(avg(same), 6) from (select user_id, count(case when rank <= 5 then 1 end)::double / count(*) as same from reco group by 1)"""


@query(_all_metrics_sql())
def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric in one batch: the planner's fused tables."""
    train, test, reco = fold(spark, sf_dir)
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), "p_brand", "p_type", "p_size")
    kinds: dict[str, M.MetricAtK] = {}
    for k in (1, 5, 10):
        kinds |= {f"{n}@{k}": m(k) for n, m in (("prec", M.Precision), ("recall", M.Recall), ("f1", M.F1Beta), ("acc", M.Accuracy), ("mcc", M.MCC), ("hit", M.HitRate), ("map", M.MAP), ("ndcg", M.NDCG), ("mrr", M.MRR), ("pauc", M.PartialAUC),
                                                ("pap", M.PAP), ("miuf", M.MeanInvUserFreq), ("arp", M.AvgRecPopularity), ("ser", M.Serendipity), ("cov", M.CatalogCoverage), ("users", M.CoveredUsers), ("suff", M.SufficientReco), ("unrep", M.UnrepeatedReco))}
    kinds |= {"ild@10": M.IntraListDiversity(10, M.PairwiseHammingDistanceCalculator(part)), "same@10": M.Intersection(10, 5)}
    return metric_table(kinds, reco, test, train, train.select(Columns.Item), reco).select("metric", F.round("value", 6).alias("value"))


# Validation, two stages, reports, streams.


def _fold_recall_sql(i: int) -> str:
    """One of two folds of 14 days."""
    fold_sql = FOLD.replace("interval 28 day", "interval 14 day").replace("+ interval 1 day as hi", f"+ interval 1 day - interval {14 * (1 - i)} day as hi")
    return f"""(with {fold_sql} select 'popular' as model, {i} as i_split, 'recall' as metric, round(avg(tp / n), 9) as value
    from (select t.user_id, count(r.rank)::double as tp, count(*) as n from test t left join reco r on t.user_id = r.user_id and t.item_id = r.item_id group by 1))"""


@query(f"select * from {_fold_recall_sql(0)} union all select * from {_fold_recall_sql(1)}")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = Dataset.construct(interactions(spark, sf_dir))
    found = cross_validate_table(ds, TimeRangeSplitter("14D", 2), {"recall": M.Recall(10)}, {"popular": O.PopularModel()}, 10, True, on_unsupported_targets="ignore")
    return found.select(Columns.Model, Columns.Split, "metric", F.round("value", 9).alias("value"))


class _Features(CandidateFeatureCollector):
    def __init__(self, part: DataFrame):
        self.part = part

    def get_user_features(self, users: DataFrame, dataset: Dataset) -> DataFrame:
        return dataset.raw.groupBy(Columns.User).agg(F.count("*").alias("n_rows"), F.avg(Columns.Weight).alias("mean_weight"))

    def get_item_features(self, items: DataFrame, dataset: Dataset) -> DataFrame:
        return self.part


def _two_stage(spark: SparkSession, sf_dir: str, trees: bool = False) -> tuple[CandidateRankingModel, Dataset]:
    from pyspark.ml.classification import GBTClassifier, LogisticRegression

    ds = Dataset.construct(interactions(spark, sf_dir))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), "p_size", "p_retailprice")
    generators = [
        CandidateGenerator(O.PopularModel(), 30, True, True, ranks_fillna_value=31, scores_fillna_value=0.0), CandidateGenerator(O.PopularModel("sum_weight"), 30, True, False, ranks_fillna_value=31),
    ]
    return CandidateRankingModel(generators, SPLITTER, Reranker(GBTClassifier(maxIter=5, maxDepth=4, seed=1) if trees else LogisticRegression(maxIter=5)), PerUserNegativeSampler(3, 1), _Features(part)), ds


CANDIDATES_SQL = f"""with {FOLD}, ranked2 as (select item_id, row_number() over (order by sum(weight) desc, item_id) as pos from train group by item_id),
c1 as (select user_id, item_id, score, rank from (select u.user_id, r.item_id, r.score, row_number() over (partition by u.user_id order by r.pos)::int as rank from (select distinct user_id from test) u, (select * from ranked where pos <= 400) r
  where not exists (select 1 from train s where s.user_id = u.user_id and s.item_id = r.item_id)) where rank <= 30),
c2 as (select user_id, item_id, rank from (select u.user_id, r.item_id, row_number() over (partition by u.user_id order by r.pos)::int as rank from (select distinct user_id from test) u, (select * from ranked2 where pos <= 400) r
  where not exists (select 1 from train s where s.user_id = u.user_id and s.item_id = r.item_id)) where rank <= 30),
both_ as (select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.item_id, b.item_id) as item_id, coalesce(a.rank, 31) as r1, coalesce(a.score, 0) as s1, coalesce(b.rank, 31) as r2 from c1 a full outer join c2 b on a.user_id = b.user_id and a.item_id = b.item_id),
flagged as (select c.*, (exists (select 1 from test t where t.user_id = c.user_id and t.item_id = c.item_id))::int as target from both_ c),
drawn as (select *, row_number() over (partition by user_id, target order by {MD5.format("concat_ws('|', 1, user_id, item_id)")}, item_id) as d from flagged)
select user_id, item_id, r1::int as r1, s1::double as s1, r2::int as r2, target from drawn where target = 1 or d <= 3"""


@query(CANDIDATES_SQL)
def two_stage_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, ds = _two_stage(spark, sf_dir)
    model.feature_collector = CandidateFeatureCollector()
    train = model.get_train_with_targets_for_reranker(ds)
    return train.select(*Columns.UserItem, F.col("PopularModel_1_rank").alias("r1"), F.col("PopularModel_1_score").cast("double").alias("s1"), F.col("PopularModel_2_rank").alias("r2"), Columns.Target)


@query()
def two_stage_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, ds = _two_stage(spark, sf_dir)
    model.fit(ds)
    return model.recommend(ds.hot(Columns.User), ds, 10, True, on_unsupported_targets="ignore")


@query()
def two_stage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with gradient-boosted trees for the reranker."""
    model, ds = _two_stage(spark, sf_dir, trees=True)
    model.fit(ds)
    return model.recommend(ds.hot(Columns.User), ds, 10, True, on_unsupported_targets="ignore")


@query(
    f"""with {FOLD}, chosen as (select user_id from (select distinct user_id from reco) order by {MD5.format("concat_ws('|', 32, user_id)")}, user_id limit 5), named as (select user_id, 'random_' || row_number() over (order by user_id) as request_name from chosen)
    select request_name, r.user_id, r.item_id, r.rank, p_brand as brand from reco r join named using (user_id) left join part on p_partkey = r.item_id"""
)
def report_reco(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, reco = fold(spark, sf_dir)
    data = table(spark, sf_dir, "part").select(F.col("p_partkey").alias(Columns.Item), F.col("p_brand").alias("brand"))
    found = ReportStorage.from_raw({"popular": reco}, train, data, n_random_requests=5)
    return found.reco.select("request_name", Columns.User, Columns.Item, Columns.Rank, "brand")


@query("select p_brand as model, 'x' as kind, round(avg(v), 6) as v from (select p_brand, p_type, avg(p_retailprice) as v from part group by 1, 2) group by 1")
def report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    types = dense_index(part.select("p_type").distinct().withColumn("z", F.lit(0).cast("long")), "z", ["p_type"], Columns.Split)
    rows = part.join(types, "p_type").groupBy(F.col("p_brand").alias(Columns.Model), Columns.Split).agg(F.avg("p_retailprice").alias("v"))
    report = MetricsReport(rows, ["v"], ["kind"])
    report.data = rows.withColumn("kind", F.lit("x"))
    return report.average().select(Columns.Model, "kind", F.round("v", 6).alias("v"))


POPULARITY_SQL = "select date_trunc('day', ts) as window_start, event_type as item_id, count(*)::bigint as n_interactions, round(sum(value), 4) as sum_weight from events group by 1, 2"


@query(POPULARITY_SQL)
def windowed_popularity_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias(Columns.Item), F.col("value").alias(Columns.Weight), F.col("ts").alias(Columns.Datetime))
    return windowed_popularity(events).withColumn("sum_weight", F.round("sum_weight", 4))


@query(POPULARITY_SQL)
def windowed_popularity_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    return run_once(spark, f"{sf_dir}/events.parquet", f"popularity_{uuid.uuid4().hex}").withColumn("sum_weight", F.round("sum_weight", 4))


def queries() -> dict[str, Query]:
    return {n.removesuffix("_q"): f for n, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {n.removesuffix("_q"): s for n, s in SQL.items()}
