"""Queries over face vectors, the clusters that they form, and the people in them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photolake.functions import vectors as V
from photolake.operators import clustering, export, identity, incremental, manual, people, views
from photolake.plans import fixtures as X
from photolake.plans.catalog import query
from photolake.plans.views import D2, over

#: Radius and least neighbours that split the supplied vectors into some clusters.
EPS, LEAST = 1.14, 3


def _clustered(spark, sf_dir: str) -> DataFrame:
    """All faces with the clusters of their vectors, numbered in the order of photos and faces."""
    faces = X.faces(spark, sf_dir).withColumn("ord", F.col("photo_ord") * 1_000_000 + F.col("face_ord"))
    labels = clustering.dbscan(faces.select("ord", "embedding"), EPS, LEAST)
    return faces.join(labels, "ord")


@query("select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm, round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first_part from embeddings")
def l2_normalize(spark, sf_dir: str) -> DataFrame:
    e = X.table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.get(V.normalized(F.col("embedding")), F.lit(0)), 6).alias("first_part"))


@query(f"select a.vec_id as a, b.vec_id as b, round({D2}, 6) as d2 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def pair_distance(spark, sf_dir: str) -> DataFrame:
    """Squared distance of each vector to the next."""
    e = X.table(spark, sf_dir, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("va")), e.select(F.col("vec_id").alias("b"), F.col("embedding").alias("vb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(V.squared_distance(F.col("va"), F.col("vb")), 6).alias("d2"))


@query(f"select a.vec_id as a, b.vec_id as b, round({D2}, 6) as d2 from embeddings a join embeddings b on a.vec_id < b.vec_id where {D2} <= 1.14 * 1.14")
def eps_neighbors(spark, sf_dir: str) -> DataFrame:
    found = clustering.neighbours(X.vectors(spark, sf_dir), EPS)
    return found.select("a", "b", F.round("d2", 6).alias("d2"))


@query(over("select ord, degree, degree >= 3 as core from degrees", "degrees"))
def dbscan_degree(spark, sf_dir: str) -> DataFrame:
    """How many vectors, itself included, lie within reach of each."""
    return _clustered(spark, sf_dir).select("ord", "degree", (F.col("degree") >= LEAST).alias("core"))


@query(over("select ord, cluster_id from labels_of", "labels_of"))
def dbscan_labels(spark, sf_dir: str) -> DataFrame:
    return _clustered(spark, sf_dir).select("ord", "cluster_id")


@query(over("select ord, degree, cluster_id from labels_of", "labels_of"))
def incremental_labels(spark, sf_dir: str) -> DataFrame:
    """All faces grouped in three batches, each added to what was found before."""
    faces = X.faces(spark, sf_dir).withColumn("ord", F.col("photo_ord") * 1_000_000 + F.col("face_ord"))
    grouping = incremental.empty(spark, EPS, LEAST)
    for low, high in ((0, 4), (4, 8), (8, 10)):
        grouping = incremental.added(grouping, faces.where((F.col("label") >= low) & (F.col("label") < high)))
    return incremental.labels(grouping)


@query(f"select a.vec_id as ord, null::bigint as cluster_id from embeddings a")
def dbscan_default(spark, sf_dir: str) -> DataFrame:
    """The default radius, at which no two of the supplied vectors are near."""
    return clustering.dbscan(X.vectors(spark, sf_dir), 0.75, 2).select("ord", "cluster_id")


PEOPLE_SQL = """best as (select cluster_id, path, x1, y1, x2, y2 from (select *, row_number() over (partition by cluster_id order by confidence desc, photo_ord, face_ord) as r from clustered where cluster_id is not null and confidence > 0) where r = 1),
    counted as (select cluster_id, count(distinct path) as photo_count from clustered where cluster_id is not null group by cluster_id),
    people as (select c.cluster_id, 'Person ' || row_number() over (order by c.cluster_id) as label, coalesce(path, '') as representative, coalesce(x1, 0) as x1, coalesce(y1, 0) as y1, coalesce(x2, 0) as x2, coalesce(y2, 0) as y2, photo_count from counted c left join best using (cluster_id)),
    groups_ as (select -1::bigint as cluster_id, 'Groups' as label, min(path) as representative, count(*) as photo_count from (select path from clustered group by path having count(distinct cluster_id) > 1) having count(*) > 0),
    landscapes as (select -2::bigint as cluster_id, 'Landscapes' as label, min(path) as representative, count(*) as photo_count from photos where faces_detected_at is not null and path not in (select path from faces) having count(*) > 0)"""


def _people_sql(body: str) -> str:
    return over(f", {PEOPLE_SQL}\n{body}", "clustered", "photos")


@query(_people_sql("select * from people"))
def cluster_people(spark, sf_dir: str) -> DataFrame:
    """Each person's label, best face and number of photos."""
    return people.people(_clustered(spark, sf_dir))


@query(_people_sql("select cluster_id, label, representative, photo_count from groups_ union all select * from landscapes"))
def virtual_clusters(spark, sf_dir: str) -> DataFrame:
    """Photos of several people, and photos of none."""
    found = people.summary(X.photos(spark, sf_dir), _clustered(spark, sf_dir))
    return found.where("kind > 0").select("cluster_id", "label", "representative", "photo_count")


@query(_people_sql("select *, 0::bigint as kind from people union all select cluster_id, label, representative, 0, 0, 0, 0, photo_count, 1 from groups_ union all select cluster_id, label, representative, 0, 0, 0, 0, photo_count, 2 from landscapes"))
def cluster_summary(spark, sf_dir: str) -> DataFrame:
    """People, then groups, then landscapes: the flagship query."""
    return people.summary(X.photos(spark, sf_dir), _clustered(spark, sf_dir)).withColumn("kind", F.col("kind").cast("long"))


@query(_people_sql("select cluster_id, case when cluster_id % 2 = 0 then 'Named ' || cluster_id else label end as label from people"))
def renamed_people(spark, sf_dir: str) -> DataFrame:
    """Labels given by hand laid over the numbered ones."""
    found = people.people(_clustered(spark, sf_dir)).select("cluster_id", "label")
    names = found.where("cluster_id % 2 = 0").select("cluster_id", F.concat(F.lit("Named "), F.col("cluster_id").cast("string")).alias("new_label"))
    return manual.renamed_clusters(found, names)


GREEDY_SQL = """seen as (select label::bigint as person_id, cluster_id from clustered),
    pairs as (select *, row_number() over (order by shared desc, faces, person_id, cluster_id) as r from (select person_id, cluster_id, count(*) as shared from seen where cluster_id is not null group by 1, 2) join (select person_id, count(*) as faces from seen group by 1) using (person_id)),
    walk as (select 0::bigint as r, []::bigint[] as p, []::bigint[] as c, []::bigint[] as kept
        union all select w.r + 1, case when ok then list_append(p, person_id) else p end, case when ok then list_append(c, cluster_id) else c end, case when ok then list_append(kept, n) else kept end
        from (select w.r, w.p, w.c, w.kept, x.person_id, x.cluster_id, x.r as n, not list_contains(w.p, x.person_id) and not list_contains(w.c, x.cluster_id) as ok from walk w join pairs x on x.r = w.r + 1) w),
    matched as (select person_id, cluster_id, shared from pairs where list_contains((select arg_max(kept, r) from walk), r)),
    free as (select cluster_id, row_number() over (order by cluster_id) + (select max(person_id) from seen) as person_id from (select distinct cluster_id from seen where cluster_id is not null and cluster_id not in (select cluster_id from matched)))"""


@query(over(f", {GREEDY_SQL}\nselect cluster_id, person_id, shared from matched union all select cluster_id, person_id, null from free", "clustered"))
def lasting_people(spark, sf_dir: str) -> DataFrame:
    """Which person of an earlier grouping (the labels) each cluster is, and new numbers for the others."""
    found = _clustered(spark, sf_dir)
    return identity.lasting(found.select("ord", F.col("label").cast("long").alias("person_id")), found.select("ord", "cluster_id"), "ord")


@query(over("select path, grade from photos where path in (select path from faces where label = 3)", "photos", "faces"))
def view_person(spark, sf_dir: str) -> DataFrame:
    faces = X.faces(spark, sf_dir).withColumn("cluster_id", F.col("label").cast("long"))
    return views.of_person(X.photos(spark, sf_dir), faces, 3).select("path", "grade")


@query(over("select path from photos where path in (select path from clustered group by path having count(distinct cluster_id) > 1)", "clustered", "photos"))
def view_groups(spark, sf_dir: str) -> DataFrame:
    return views.of_person(X.photos(spark, sf_dir), _clustered(spark, sf_dir), -1).select("path")


@query(over("select path from photos where faces_detected_at is not null and path not in (select path from faces)", "photos", "faces"))
def view_landscapes(spark, sf_dir: str) -> DataFrame:
    return views.of_person(X.photos(spark, sf_dir), X.faces(spark, sf_dir), -2).select("path")


@query(_people_sql("select p.path, '/out/' || coalesce(l.label, 'Ungrouped') || '/' || p.filename as dest from photos p left join clustered c on c.path = p.path and c.face_ord = 0 left join people l on l.cluster_id = c.cluster_id where p.grade in ('Ok', 'Good', 'Ungraded')"))
def export_plan_by_person(spark, sf_dir: str) -> DataFrame:
    """One folder for each person; a photo goes to the person of its first face."""
    found = _clustered(spark, sf_dir)
    return export.plan_by_person(X.photos(spark, sf_dir), found, people.people(found), "OkAndGood", "/out")


@query(_people_sql("select p.path, '/out/' || coalesce(l.label, 'Ungrouped') || '/' || p.filename as dest from photos p left join (select distinct path, cluster_id from clustered where cluster_id is not null) c on c.path = p.path left join people l on l.cluster_id = c.cluster_id"))
def export_plan_everyone(spark, sf_dir: str) -> DataFrame:
    """A copy of each photo for everyone in it."""
    found = _clustered(spark, sf_dir)
    return export.plan_by_person(X.photos(spark, sf_dir), found, people.people(found), "All", "/out", everyone=True)


@query(
    """with v as (select vec_id as ord, embedding, label, lag(vec_id) over w as previous, lag(embedding) over w as before, lag(label) over w as s from embeddings window w as (order by vec_id)),
    c as (select *, list_sum(list_transform(list_zip(before, embedding), lambda z: z[1]::double * z[2]::double)) / (sqrt(list_sum(list_transform(before, lambda x: x::double * x::double))) * sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)))) as cosine from v where before is not null)
    select previous, ord, round(cosine, 6) as cosine, case when label > s then previous else ord end as loser from c where cosine > 0.3"""
)
def consecutive_duplicates(spark, sf_dir: str) -> DataFrame:
    """Neighbouring photos that look alike, and which of the two scores lower."""
    v = X.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), "embedding", F.col("label").alias("score"))
    return clustering.consecutive_duplicates(v, 0.3).withColumn("cosine", F.round("cosine", 6))
