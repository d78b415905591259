"""Explicit schemas of the store's tables, and the fixed code tables."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "images": "gid BIGINT, image_uuid STRING, uri STRING, ext STRING, width INT, height INT, time_posix BIGINT, timedelta_posix BIGINT, gps_lat DOUBLE, gps_lon DOUBLE, orientation INT, reviewed BOOLEAN, contributor_id BIGINT, party_id BIGINT, note STRING, metadata_json STRING",
    "annots": "aid BIGINT, annot_uuid STRING, gid BIGINT, nid BIGINT, species_id BIGINT, xtl INT, ytl INT, width INT, height INT, theta DOUBLE, verts ARRAY<ARRAY<INT>>, viewpoint INT, quality INT, detect_confidence DOUBLE, exemplar BOOLEAN, reviewed BOOLEAN, multiple BOOLEAN, interest BOOLEAN, staged BOOLEAN, staged_user STRING, age_min INT, age_max INT, tags ARRAY<STRING>, static_encounter STRING, note STRING, metadata_json STRING",
    "names": "nid BIGINT, name_uuid STRING, name_text STRING, alias STRING, sex INT, temp BOOLEAN, note STRING",
    "species": "species_id BIGINT, species_text STRING, nice STRING, code STRING, enabled BOOLEAN",
    "imagesets": "imgsetid BIGINT, text STRING, start_posix BIGINT, end_posix BIGINT, gps_lat DOUBLE, gps_lon DOUBLE, processed BOOLEAN, shipped BOOLEAN, metadata_json STRING",
    "imageset_images": "imgsetid BIGINT, gid BIGINT",
    "annotmatch": "am_id BIGINT, aid1 BIGINT, aid2 BIGINT, evidence_decision INT, meta_decision INT, confidence INT, tags ARRAY<STRING>, reviewer STRING, modified_posix BIGINT, count INT",
    "reviews": "review_id BIGINT, aid1 BIGINT, aid2 BIGINT, review_count INT, evidence_decision INT, meta_decision INT, user STRING, user_confidence INT, tags ARRAY<STRING>, client_start BIGINT, client_end BIGINT, server_start BIGINT, server_end BIGINT",
    "contributors": "contributor_id BIGINT, tag STRING, first STRING, last STRING, city STRING, state STRING, country STRING",
    "parts": "part_id BIGINT, part_uuid STRING, aid BIGINT, xtl INT, ytl INT, width INT, height INT, theta DOUBLE, type STRING, contour_json STRING",
    "annotgroups": "group_id BIGINT, text STRING, note STRING",
    "annotgroup_annots": "group_id BIGINT, aid BIGINT",
    "metadata": "key STRING, value STRING",
    "descriptors": "aid BIGINT, fx INT, vec ARRAY<FLOAT>, fgw DOUBLE",
}

#: The natural key by which rows of a table are told apart when they are appended or merged.
SUPERKEYS: dict[str, tuple[str, ...]] = {
    "images": ("image_uuid",), "annots": ("annot_uuid",), "names": ("name_text",), "species": ("species_text",), "imagesets": ("text",), "imageset_images": ("imgsetid", "gid"),
    "annotmatch": ("aid1", "aid2"), "reviews": ("aid1", "aid2", "review_count"), "contributors": ("tag",), "parts": ("part_uuid",), "annotgroups": ("text",), "annotgroup_annots": ("group_id", "aid"), "metadata": ("key",),
}

# Codes of decisions, confidences and qualities.
EVIDENCE = {"unreviewed": None, "nomatch": 0, "match": 1, "notcomp": 2, "unknown": 3}
META = {"null": None, "diff": 0, "same": 1}
CONFIDENCE = {"unknown": None, "guessing": 1, "not_sure": 2, "pretty_sure": 3, "absolutely_sure": 4}
QUALITY = {"unknown": None, "junk": 1, "poor": 2, "ok": 3, "good": 4, "excellent": 5}
#: What a review's confidence adds to an edge's weight in a minimum cut.
CONFIDENCE_WEIGHT = {"absolutely_sure": 4.0, "pretty_sure": 0.6, "not_sure": 0.2, "guessing": 0.0, "unknown": 0.0}


def ring_distance(order: list[str]) -> list[tuple[str, str, int]]:
    """Distances between categories on a ring, such as the eight compass views: the lesser number of steps."""
    n = len(order)
    return [(a, b, min((i - j) % n, (j - i) % n)) for i, a in enumerate(order) for j, b in enumerate(order)]
