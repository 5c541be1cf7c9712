"""The tables of :mod:`photolake.plans.fixtures` once more, in SQL, for the queries' counterparts."""

from __future__ import annotations

#: Squared distance of two vectors ``a.embedding`` and ``b.embedding``.
D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"


def iou(a: str, b: str) -> str:
    """Overlap of two boxes whose sides are reached as ``{a}.x1`` and so on."""
    both = f"greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    area = lambda x: f"({x}.x2 - {x}.x1) * ({x}.y2 - {x}.y1)"
    return f"(({both}) / ({area(a)} + {area(b)} - ({both}) + 1e-6))"


#: Each view with the views that it reads.
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "files": ((), "select doc_id as photo_ord, '/p/IMG_' || doc_id || '.jpg' as path, 'IMG_' || doc_id || '.jpg' as filename, sha256(array_slice(encode(text), 1, 65536)) as content_hash from documents"),
    "stored": (
        ("files",),
        """select f.path, f.filename, case when toxic = 1 then 'Bad' else 'Good' end as grade, case when toxic = 1 then 'Manual' else 'Auto' end as grade_source,
        case when toxic = 1 then null when quality = 0 then sha256(f.content_hash || 'old') else f.content_hash end as content_hash,
        case when quality = 1 then 1000 end::bigint as graded_at, 2000::bigint as faces_detected_at
        from files f join labels l on l.doc_id = f.photo_ord
        union all select '/p/OLD_' || page_id || '.png', 'OLD_' || page_id || '.png', 'Ungraded', 'Unset', '0', null, null from pages""",
    ),
    "photos": (
        ("files",),
        """select f.photo_ord, f.path, f.filename, f.content_hash,
        case when toxic = 1 then 'Bad' when quality = 1 then 'Good' when quality = 0 then 'Ok' else 'Ungraded' end as grade,
        case when toxic = 1 or quality = 1 then 'Manual' when quality = 0 then 'Auto' else 'Unset' end as grade_source,
        case when quality = 0 then 1000 end::bigint as graded_at, case when quality is not null then 2000 end::bigint as faces_detected_at
        from files f left join labels l on l.doc_id = f.photo_ord""",
    ),
    "raw_faces": (
        (),
        """select (vec_id * vec_id * 31 + vec_id * 17) % 150 as photo_ord, vec_id, ((vec_id * 7919) % 1000) / 1000.0::double as confidence,
        (vec_id * 37 % 200)::double as x1, (vec_id * 53 % 150)::double as y1, (vec_id * 37 % 200 + 40 + vec_id * 13 % 160)::double as x2, (vec_id * 53 % 150 + 40 + vec_id * 29 % 160)::double as y2,
        embedding, label from embeddings""",
    ),
    "faces": (("raw_faces",), "select *, '/p/IMG_' || photo_ord || '.jpg' as path, row_number() over (partition by photo_ord order by confidence desc, vec_id) - 1 as face_ord from raw_faces"),
    "gated": (("faces",), "select * from faces where confidence >= 0.5 and least(x2 - x1, y2 - y1) >= 80"),
    "turns": (("gated",), "select *, row_number() over (partition by photo_ord order by confidence desc, face_ord) as turn from gated"),
    "folds": (
        ("turns",),
        f"""select photo_ord, 1::bigint as turn, [struct_pack(vec_id := vec_id, face_ord := face_ord, confidence := confidence, x1 := x1, y1 := y1, x2 := x2, y2 := y2)] as boxes from turns where turn = 1
        union all select t.photo_ord, t.turn, case when len(list_filter(f.boxes, lambda k: {iou("k", "t")} > 0.4)) > 0 then f.boxes
        else list_append(f.boxes, struct_pack(vec_id := t.vec_id, face_ord := t.face_ord, confidence := t.confidence, x1 := t.x1, y1 := t.y1, x2 := t.x2, y2 := t.y2)) end
        from folds f join turns t on t.photo_ord = f.photo_ord and t.turn = f.turn + 1""",
    ),
    "unsuppressed": (("folds",), "select photo_ord, b.vec_id as vec_id, b.face_ord as face_ord, b.confidence as confidence, b.x1 as x1, b.y1 as y1, b.x2 as x2, b.y2 as y2 from (select photo_ord, unnest(boxes) as b from (select photo_ord, arg_max(boxes, turn) as boxes from folds group by photo_ord))"),
    "capped": (("unsuppressed",), "select * from (select *, row_number() over (partition by photo_ord order by confidence desc, face_ord) as rank from unsuppressed) where rank <= 10"),
    "points": (("faces",), "select photo_ord * 1000000 + face_ord as ord, path, embedding from faces"),
    "near": (("points",), f"select a.ord as a, b.ord as b from points a join points b on a.ord < b.ord where {D2} <= 1.14 * 1.14"),
    "links": (("near",), "select a, b from near union all select b, a from near"),
    "degrees": (("links", "points"), "select p.ord, 1 + count(b.a) as degree from points p left join links b on b.a = p.ord group by p.ord"),
    "cores": (("degrees",), "select ord from degrees where degree >= 3"),
    "reach": (("cores", "links"), "select ord, ord as other from cores union select r.ord, b.b from reach r join links b on b.a = r.other join cores c on c.ord = b.b"),
    "roots": (("reach",), "select ord, min(other) as root from reach group by ord"),
    "numbers": (("roots",), "select ord, dense_rank() over (order by root) - 1 as cluster_id from roots"),
    "labels_of": (
        ("numbers", "links", "degrees"),
        """select d.ord, d.degree, coalesce(n.cluster_id, m.cluster_id) as cluster_id from degrees d left join numbers n on n.ord = d.ord
        left join (select b.a as ord, min(n.cluster_id) as cluster_id from links b join numbers n on n.ord = b.b group by b.a) m on m.ord = d.ord""",
    ),
    "clustered": (("faces", "labels_of"), "select f.*, l.cluster_id from faces f join labels_of l on l.ord = f.photo_ord * 1000000 + f.face_ord"),
    "rasters": (
        (),
        "select vec_id, list_transform(embedding, lambda e: greatest(0.0::double, least(255.0::double, floor((e::double * 2 + 0.5) * 255)))) as gray from embeddings",
    ),
    "laplacians": (("rasters",), "select vec_id, gray[(y - 1) * 8 + x + 1] + gray[(y + 1) * 8 + x + 1] + gray[y * 8 + x] + gray[y * 8 + x + 2] - 4 * gray[y * 8 + x + 1] as l from rasters, range(1, 7) ys(y), range(1, 7) xs(x)"),
    "sharpness": (("laplacians",), "select vec_id, sum(l * l) / 36 - (sum(l) / 36) * (sum(l) / 36) as sharpness from laplacians group by vec_id"),
    "colours": (("rasters",), "select vec_id, greatest(gray[k], gray[k + 21], gray[k + 42]) as high, least(gray[k], gray[k + 21], gray[k + 42]) as low from rasters, range(1, 22) ks(k)"),
    "saturations": (("colours",), "select vec_id, sum(case when high > 0 then (high - low) / high else 0 end) / 21 as saturation from colours group by vec_id"),
    "measures": (
        ("rasters", "sharpness", "saturations"),
        """select vec_id, sharpness, len(list_filter(gray, lambda v: v >= 246)) / 64.0::double > 0.06 as over_, len(list_filter(gray, lambda v: v < 10)) / 64.0::double > 0.06 as under_,
        least(1.0, sqrt(greatest(0.0, list_sum(list_transform(gray, lambda v: v * v)) / 64 - (list_sum(gray) / 64) * (list_sum(gray) / 64))) / 128) as contrast, saturation
        from rasters join sharpness using (vec_id) join saturations using (vec_id)""",
    ),
    "scored": (("measures",), "select *, greatest(0.0, least(10.0, 10 * (0.5 * contrast + 0.5 * saturation))) as score from measures"),
    "graded": (("scored",), "select *, case when sharpness < 55000 or over_ or under_ then 'Bad' when score >= 5.5 then 'Good' else 'Ok' end as grade from scored"),
}


def over(body: str, *names: str) -> str:
    """SQL of ``body`` behind the views ``names`` and those that they read."""
    found: list[str] = []

    def need(name: str) -> None:
        for other in VIEWS[name][0]:
            need(other)
        if name not in found:
            found.append(name)

    for name in names:
        need(name)
    return "with recursive " + ",\n".join(f"{n} as ({VIEWS[n][1]})" for n in found) + "\n" + body
