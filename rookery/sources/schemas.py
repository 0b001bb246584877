"""Schemas of the nine social tables, and of the star-schema files they can be derived from.

Schemas are DDL text, so that importing this module needs no session.
"""

from __future__ import annotations

SOCIAL = {
    "users": (
        "id BIGINT, handle STRING, username STRING, email STRING, password STRING, first_name STRING, "
        "last_name STRING, bio STRING, profile_photo STRING, authenticated BOOLEAN, up_points INT, "
        "creation_time TIMESTAMP_NTZ, last_update_time TIMESTAMP_NTZ"
    ),
    "posts": (
        "post_id BIGINT, camp_id BIGINT, user_id BIGINT, reply_to_id BIGINT, media_id BIGINT, "
        "creation_time TIMESTAMP_NTZ, last_update_time TIMESTAMP_NTZ, post_text STRING, post_img_url STRING, "
        "opacity DECIMAL(5,4), is_deleted INT"
    ),
    "post_votes": (
        "vote_id BIGINT, camp_id BIGINT, user_id BIGINT, post_id BIGINT, value DECIMAL(5,3), "
        "added_time TIMESTAMP_NTZ"
    ),
    "follows": (
        "follow_id BIGINT, user_id BIGINT, following BIGINT, follow_value INT, "
        "creation_time TIMESTAMP_NTZ, last_update_time TIMESTAMP_NTZ"
    ),
    "notifications": (
        "notification_id BIGINT, user_id BIGINT, triggered_by_user_id BIGINT, event_type_id INT, "
        "reference_post_id BIGINT, seen INT, seen_time TIMESTAMP_NTZ, creation_time TIMESTAMP_NTZ, "
        "last_update_time TIMESTAMP_NTZ"
    ),
    "tokens": (
        "token_id BIGINT, user_id BIGINT, token STRING, type INT, used INT, creation_time TIMESTAMP_NTZ, "
        "last_update_time TIMESTAMP_NTZ"
    ),
    "camp_directory": ("record_id BIGINT, camp_id BIGINT, user_id BIGINT, added_time TIMESTAMP_NTZ"),
    "camps": (
        "camp_id BIGINT, camp_hash STRING, camp_name STRING, camp_type INT, creation_time TIMESTAMP_NTZ, "
        "last_update_time TIMESTAMP_NTZ, camp_img_url STRING"
    ),
    "media": ("media_id BIGINT, post_id BIGINT, photo_url STRING, added_time TIMESTAMP_NTZ"),
}

# Columns that saved tables have besides, to be filtered by.
LAYOUT = {"users": "handle_lower STRING", "posts": "local_month STRING"}

# Key to read a table in parallel over JDBC.
NUMERIC_KEY = {
    "users": "id",
    "posts": "post_id",
    "post_votes": "vote_id",
    "follows": "follow_id",
    "notifications": "notification_id",
    "tokens": "token_id",
    "camp_directory": "record_id",
    "camps": "camp_id",
    "media": "media_id",
}

STAR = {
    "region": ("r_regionkey INT, r_name STRING"),
    "customer": (
        "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING"
    ),
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": ("doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"),
}
