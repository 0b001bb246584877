"""The registered questions in SQL, written against the tables' plain definition.

Every statement starts with the same derivation of the social tables. Scores are written
without pre-aggregation and feeds without the per-author cut, to check those steps.
"""

from __future__ import annotations

_SOCIAL = """
WITH sizes AS (
  SELECT d.nd, c.nc, o.no, o.t0 FROM (SELECT count(*) AS nd FROM documents) d
  CROSS JOIN (SELECT count(*) AS nc FROM customer) c
  CROSS JOIN (SELECT count(*) AS no, min(o_orderdate) AS t0 FROM orders) o),
users AS (
  SELECT c_custkey AS id, replace(c_name, '#', '_') AS handle, concat('u', CAST(c_custkey AS STRING), '@example.com') AS email,
         concat(c_mktsegment, ' person') AS first_name,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('p', CAST(c_custkey AS STRING), '.jpg') END AS profile_photo,
         CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS bio,
         k.t0 + INTERVAL '1' MINUTE * ((c_custkey * 37) % k.nc) AS creation_time
  FROM customer CROSS JOIN sizes k),
posts AS (
  SELECT o.o_orderkey AS post_id, CAST(CASE WHEN o.o_orderkey % 13 = 0 THEN 1 ELSE 0 END AS BIGINT) AS camp_id, o.o_custkey AS user_id,
         CASE o.o_orderkey % 4 WHEN 0 THEN NULL WHEN 2 THEN o.o_orderkey - 1 ELSE o.o_orderkey - o.o_orderkey % 4 END AS reply_to_id,
         CASE WHEN o.o_orderkey % 5 = 0 THEN o.o_orderkey ELSE NULL END AS media_id,
         o.o_orderdate + INTERVAL '1' MINUTE * (o.o_orderkey % 1440) AS creation_time,
         CASE WHEN o.o_orderkey % 11 = 5 THEN 1 ELSE 0 END AS is_deleted,
         concat(CASE WHEN o.o_orderkey % 7 = 0 THEN concat('hi @', replace(m.c_name, '#', '_'), ' and @nobody_here ') ELSE '' END, dd.text) AS post_text
  FROM (SELECT o1.*, o1.o_orderkey % k.nd AS doc_key, (o1.o_orderkey * 13) % k.nc AS mention_key
        FROM orders o1 CROSS JOIN sizes k) o
  JOIN documents dd ON dd.doc_id = o.doc_key
  JOIN customer m ON m.c_custkey = o.mention_key),
vote_events AS (
  SELECT CAST(CASE WHEN l_orderkey % 13 = 0 AND l_orderkey % 26 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS camp_id, l_suppkey AS user_id, l_orderkey AS post_id,
         CASE l_returnflag WHEN 'N' THEN 1.0 WHEN 'R' THEN -1.0 ELSE l_discount END AS raw_value,
         CASE l_returnflag WHEN 'N' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS value, l_shipdate AS added_time,
         row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
  FROM lineitem),
post_votes AS (
  SELECT v.camp_id, v.user_id, v.post_id, v.value, v.added_time FROM vote_events v
  WHERE v.rn = 1 AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = v.post_id AND o.o_custkey = v.user_id)),
follow_rows AS (
  SELECT o.o_custkey AS user_id, l.l_suppkey AS following, CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 0 END AS follow_value, l.l_shipdate AS creation_time,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_extendedprice
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey),
follow_events AS (
  SELECT user_id, following, follow_value, creation_time,
         row_number() OVER (PARTITION BY user_id, following ORDER BY creation_time DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice DESC) AS rn
  FROM follow_rows WHERE user_id <> following),
follows AS (SELECT user_id, following, follow_value, creation_time FROM follow_events WHERE rn = 1),
notifications AS (
  SELECT event_id AS notification_id, user_id, (event_id * 7) % k.nc AS triggered_by_user_id,
         CASE event_type WHEN 'signup' THEN 1 WHEN 'click' THEN 2 WHEN 'view' THEN 3 ELSE 0 END AS event_type_id,
         CASE WHEN event_type = 'signup' THEN NULL ELSE (event_id * 11) % k.no END AS reference_post_id,
         CASE WHEN value > 50 THEN 1 ELSE 0 END AS seen, ts AS creation_time
  FROM events CROSS JOIN sizes k),
tokens AS (
  SELECT event_id AS token_id, user_id, concat('tok', CAST(event_id AS STRING)) AS token,
         CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE NULL END AS used, ts AS creation_time
  FROM events),
media AS (SELECT p_partkey AS media_id, concat('m', CAST(p_partkey AS STRING), '.png') AS photo_url FROM part),
camp_directory AS (SELECT c_custkey AS record_id, c_custkey % 3 AS camp_id, c_custkey AS user_id FROM customer),
registrations AS (
  SELECT event_id AS request_id, ts AS request_time,
         CASE event_type WHEN 'error' THEN 'no address' WHEN 'click' THEN concat('U', CAST(user_id AS STRING), '@example.com')
              ELSE concat(event_type, CAST(user_id AS STRING), '@example.com') END AS email,
         CASE WHEN value > 300 THEN '' WHEN value > 200 THEN concat(event_type, ' with a name that is far too long') ELSE event_type END AS name,
         CASE event_type WHEN 'view' THEN concat('customer_', lpad(CAST(user_id AS STRING), 9, '0')) WHEN 'error' THEN concat('bad name ', CAST(user_id AS STRING))
              WHEN 'purchase' THEN concat('buyer_', CAST(CAST(floor(value) AS BIGINT) AS STRING)) ELSE concat('member_', CAST(user_id AS STRING)) END AS username
  FROM events),
"""

_SCORES = """
post_scores AS (SELECT post_id, CAST(sum(value) AS BIGINT) AS post_score FROM post_votes GROUP BY post_id),
counts AS (
  SELECT post_id, count(*) FILTER (WHERE value > 0) AS up_votes, count(*) FILTER (WHERE value < 0) AS down_votes
  FROM post_votes GROUP BY post_id),
replies AS (
  SELECT reply_to_id AS post_id, count(*) AS reply_count FROM posts
  WHERE reply_to_id IS NOT NULL AND is_deleted = 0 GROUP BY reply_to_id),
user_scores AS (
  SELECT u.id, CAST(sum(v.value) AS BIGINT) AS user_score FROM users u
  LEFT JOIN posts p ON p.user_id = u.id LEFT JOIN post_votes v ON v.post_id = p.post_id GROUP BY u.id),
best AS (SELECT id FROM user_scores ORDER BY user_score DESC NULLS LAST, id LIMIT 1),
mine AS (SELECT post_id, CAST(sum(value) AS BIGINT) AS vote FROM post_votes WHERE user_id = 8 GROUP BY post_id),
followed AS (SELECT following FROM follows WHERE user_id = 8 AND follow_value = 1),
roots AS (SELECT * FROM posts WHERE reply_to_id IS NULL AND is_deleted = 0),
days AS (SELECT *, CAST(CAST(creation_time - INTERVAL '5' HOUR AS DATE) AS STRING) AS day FROM roots),
cards AS (
  SELECT p.*, u.first_name, u.handle, u.profile_photo, s.post_score, b.user_score, COALESCE(m.vote, 0) AS current_user_vote,
         r.reply_count, c.up_votes, c.down_votes, COALESCE(p.user_id = best.id, FALSE) AS is_top_user
  FROM posts p LEFT JOIN users u ON u.id = p.user_id LEFT JOIN post_scores s ON s.post_id = p.post_id
  LEFT JOIN user_scores b ON b.id = p.user_id LEFT JOIN mine m ON m.post_id = p.post_id
  LEFT JOIN replies r ON r.post_id = p.post_id LEFT JOIN counts c ON c.post_id = p.post_id CROSS JOIN best),
"""


def _time(column: str) -> str:
    name = column.split(".")[-1]
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _digest(column: str) -> str:
    return f"CAST(length({column}) AS INTEGER) AS text_length, md5({column}) AS text_md5"


def _age(column: str, as_of: str) -> str:
    s = f"((epoch_us(TIMESTAMP '{as_of}') - epoch_us({column})) / 1000000.0)"
    total = f"CAST(floor({s}) AS BIGINT)"
    days = f"CAST(floor({total} / 86400.0) AS BIGINT)"
    left = f"({total} - 86400 * {days})"

    def label(amount: str, per: int, unit: str) -> str:
        return f"concat(CAST({amount} // {per} AS STRING), '{unit}')"

    return (
        f"CASE WHEN {days} <= 0 THEN CASE WHEN {left} < 10 THEN 'just now' WHEN {left} < 60 THEN {label(left, 1, 'sec')} "
        f"WHEN {left} < 3600 THEN {label(left, 60, 'min')} ELSE {label(left, 3600, 'hr')} END "
        f"WHEN {days} < 7 THEN {label(days, 1, 'd')} WHEN {days} < 31 THEN {label(days, 7, 'w')} "
        f"WHEN {days} < 365 THEN {label(days, 30, 'mo')} ELSE {label(days, 365, 'y')} END"
    )


def _shortened(t: str) -> str:
    tail = f"substr({t}, 401, 50)"
    return (
        f"CASE WHEN length({t}) <= 400 THEN {t} ELSE concat(substr({t}, 1, CAST(CASE WHEN instr({tail}, ' ') > 0 "
        f"THEN 399 + instr({tail}, ' ') ELSE least(450, length({t})) END AS INT)), '...') END"
    )


def _blank(count: str) -> str:
    return f"CASE WHEN COALESCE({count}, 0) = 0 THEN ' ' ELSE CAST({count} AS STRING) END"


_SCORE0 = "COALESCE(user_score, 0)"
_LEVEL = f"CAST(trunc({_SCORE0} / 10.0) AS BIGINT)"
_BARS = f"CAST((({_SCORE0} % 10) + 10) % 10 AS BIGINT)"
_BAR_TEXT = f"concat(repeat('⬛', {_BARS}), repeat('⬜', 10 - {_BARS}))"
_PHOTO = "COALESCE(NULLIF({0}, ''), 'no_image.jpg')"

_FEED = (
    "post_id, user_id, first_name, handle, profile_photo, strftime(creation_time, '%Y-%m-%d %H:%M:%S.%f') AS creation_time, "
    "post_score, {text}, user_score, current_user_vote, reply_count, down_votes, up_votes, is_top_user"
)
_FEED_TEXT = _FEED.format(text="post_text")
_FEED_DIGEST = _FEED.format(text=_digest("post_text"))


def _home_feed(first: int, last: int, columns: str, below: str = "") -> str:
    return f"""
edges AS (SELECT DISTINCT user_id AS viewer_id, following AS author_id FROM follows WHERE follow_value = 1
          UNION SELECT id, id FROM users),
ranked AS (
  SELECT e.viewer_id, p.post_id, row_number() OVER (PARTITION BY e.viewer_id ORDER BY p.post_id DESC) AS place
  FROM edges e JOIN roots p ON p.user_id = e.author_id {below}),
votes_cast AS (SELECT user_id, post_id, CAST(sum(value) AS BIGINT) AS vote FROM post_votes GROUP BY user_id, post_id),
feed AS (
  SELECT f.viewer_id, c.* EXCLUDE (current_user_vote), COALESCE(v.vote, 0) AS current_user_vote
  FROM ranked f JOIN cards c ON c.post_id = f.post_id
  LEFT JOIN votes_cast v ON v.user_id = f.viewer_id AND v.post_id = f.post_id WHERE f.place BETWEEN {first} AND {last})
SELECT viewer_id, {columns} FROM feed"""


def _window_board(start: str) -> str:
    return f"""shown AS (
          SELECT c.*, row_number() OVER (ORDER BY post_score DESC NULLS LAST, post_id DESC) AS place
          FROM cards c WHERE reply_to_id IS NULL AND is_deleted = 0
          AND c.creation_time - INTERVAL '5' HOUR BETWEEN {start} AND {start} + INTERVAL '1' DAY)
        SELECT CAST(place AS INTEGER) AS place, {_FEED_TEXT} FROM shown WHERE place <= 3"""


_DETAIL = (
    "c.post_id, c.camp_id, c.user_id, c.first_name, c.handle, c.profile_photo, "
    "strftime(c.creation_time, '%Y-%m-%d %H:%M:%S.%f') AS creation_time, COALESCE(c.user_score, 0) AS user_score, c.current_user_vote, "
    "COALESCE(c.reply_count, 0) AS reply_count, COALESCE(c.down_votes, 0) AS down_votes, COALESCE(c.up_votes, 0) AS up_votes, "
    "COALESCE(c.up_votes, 0) - COALESCE(c.down_votes, 0) AS net_votes, c.is_top_user, " + _digest("c.post_text")
)

_THREADS = """alive AS (SELECT post_id, reply_to_id FROM posts WHERE is_deleted = 0),
        members AS (
          SELECT post_id AS thread_id, 0 AS level, CAST(NULL AS BIGINT) AS parent_id, post_id FROM alive
          UNION ALL SELECT h.post_id, 1, h.post_id, a.post_id FROM alive h JOIN alive a ON a.reply_to_id = h.post_id
          UNION ALL SELECT h.post_id, 2, a.post_id, b.post_id FROM alive h JOIN alive a ON a.reply_to_id = h.post_id
                    JOIN alive b ON b.reply_to_id = a.post_id)"""

_ASKED = """asked AS (
          SELECT post_id FROM post_votes WHERE user_id = 8 AND value < 0 UNION SELECT post_id FROM posts WHERE user_id = 8)"""

_PEOPLE = f"""u.id, u.first_name, u.handle, {_PHOTO.format('u.profile_photo')} AS profile_photo, {_time('u.creation_time')},
  {_SCORE0} AS user_score, {_LEVEL} AS user_level, {_BARS} AS user_score_bars, {_BAR_TEXT} AS user_score_bars_print,
  CASE WHEN f.following IS NULL THEN 0 ELSE 1 END AS follow_value, u.id = best.id AS is_top_user
FROM users u JOIN user_scores s ON s.id = u.id LEFT JOIN followed f ON f.following = u.id CROSS JOIN best"""

_NOTICE_TEXT = "CASE event_type_id WHEN 1 THEN 'now follows you' WHEN 2 THEN 'replied to your post' WHEN 3 THEN 'mentioned you' ELSE '' END"
_NOTICE_LINK = (
    "CASE WHEN event_type_id = 1 THEN concat('/@', handle) WHEN event_type_id IN (2, 3) "
    "THEN concat('/post/', CAST(COALESCE(reference_post_id, 0) AS STRING)) ELSE '' END"
)

_MENTIONS = """
named AS (SELECT post_id, user_id, creation_time, unnest(regexp_extract_all(post_text, '@([a-zA-Z0-9_]+)', 1)) AS name FROM posts)
"""
_MENTION_ROWS = (
    "SELECT u.id AS user_id, n.user_id AS triggered_by_user_id, 3 AS event_type_id, n.post_id AS reference_post_id, n.creation_time "
    "FROM named n JOIN users u ON lower(u.handle) = lower(n.name)"
)
_REPLY_ROWS = (
    "SELECT q.user_id, p.user_id AS triggered_by_user_id, 2 AS event_type_id, p.reply_to_id AS reference_post_id, p.creation_time "
    "FROM posts p JOIN posts q ON q.post_id = p.reply_to_id WHERE q.user_id <> p.user_id"
)
_FOLLOW_ROWS = (
    "SELECT following AS user_id, user_id AS triggered_by_user_id, 1 AS event_type_id, CAST(NULL AS BIGINT) AS reference_post_id, creation_time "
    "FROM follow_rows WHERE follow_value = 1 AND user_id <> following"
)
_NOTICE = f"user_id, triggered_by_user_id, event_type_id, reference_post_id, {_time('creation_time')}"


_EDITED = """edits AS (
          SELECT user_id, concat(event_type, ' name') AS first_name, concat('bio of ', props) AS bio,
                 CASE WHEN event_type = 'click' THEN concat('e', CAST(event_id AS STRING), '.png') END AS photo,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
                 row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id DESC) AS prn
          FROM events)
        SELECT u.id, COALESCE(e.first_name, u.first_name) AS first_name, COALESCE(e.bio, u.bio) AS bio,
               COALESCE(f.photo, u.profile_photo) AS profile_photo
        FROM users u LEFT JOIN edits e ON e.user_id = u.id AND e.rn = 1
        LEFT JOIN edits f ON f.user_id = u.id AND f.photo IS NOT NULL AND f.prn = 1"""


def _load_tables() -> str:
    from .queries import FILLED

    def text(column: str) -> str:
        plain = f"CAST({column} AS STRING)"
        return f"COALESCE({f'substr({plain}, 1, 19)' if column.endswith('_time') else plain}, '-')"

    parts = []
    for table, columns in FILLED.items():
        source = "(SELECT r_regionkey AS camp_id, r_name AS camp_name FROM region)" if table == "camps" else table
        digest = f"md5(concat_ws('|', {', '.join(map(text, columns.split()))}))"
        content = f"CAST(sum(CAST('0x' || substr({digest}, 1, 8) AS BIGINT)) AS BIGINT)"
        parts.append(f"SELECT '{table}' AS table_name, count(*) AS n_rows, {content} AS content FROM {source}")
    return "done AS (SELECT 1) " + " UNION ALL ".join(parts)


_PLAIN: dict[str, str] = {
    "load_tables": _load_tables(),
    "append_events": """done AS (SELECT 1)
        SELECT strftime(added_time, '%Y-%m') AS event_month, count(*) AS n_events, CAST(sum(value) AS BIGINT) AS score
        FROM vote_events GROUP BY 1""",
    "latest_post_id": "done AS (SELECT 1) SELECT max(post_id) AS latest_post_id, max(post_id) + 1 AS cursor FROM posts",
    "latest_post_id_by_user": """done AS (SELECT 1)
        SELECT user_id, max(post_id) AS latest_post_id, max(post_id) + 1 AS cursor FROM posts GROUP BY user_id""",
    "normalise_votes": """done AS (SELECT 1)
        SELECT user_id, post_id, raw_value, CASE WHEN raw_value = 1 THEN 1 WHEN raw_value = -1 THEN -1 ELSE 0 END AS exact_value,
               CASE WHEN raw_value >= 0 THEN 1 ELSE -1 END AS sign_value FROM vote_events""",
    "normalise_votes_exact": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, {_time('added_time')}, value FROM vote_events""",
    "normalise_votes_sign": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, {_time('added_time')}, CASE WHEN raw_value >= 0 THEN 1 ELSE -1 END AS value FROM vote_events""",
    "reject_self_votes": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, {_time('added_time')}, raw_value FROM vote_events v
        WHERE NOT EXISTS (SELECT 1 FROM posts p WHERE p.post_id = v.post_id AND p.user_id = v.user_id)""",
    "apply_votes": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, value, {_time('added_time')} FROM post_votes""",
    "apply_follows": f"""done AS (SELECT 1)
        SELECT user_id, following, follow_value, {_time('creation_time')} FROM follows""",
    "apply_votes_bucketed": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, value, {_time('added_time')} FROM post_votes""",
    "apply_follows_bucketed": f"""done AS (SELECT 1)
        SELECT user_id, following, follow_value, {_time('creation_time')} FROM follows""",
    "apply_profile_edits_bucketed": _EDITED,
    "resolve_handles": f"""done AS (SELECT 1)
        SELECT user_id, following, follow_value, {_time('creation_time')} FROM follow_rows""",
    "apply_post_deletes": """asked AS (
          SELECT DISTINCT l_orderkey AS post_id, CASE WHEN l_linenumber = 1 THEN o_custkey ELSE l_suppkey END AS user_id
          FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'A')
        SELECT p.post_id, p.user_id, CASE WHEN a.post_id IS NOT NULL THEN 1 ELSE p.is_deleted END AS is_deleted
        FROM posts p LEFT JOIN asked a ON a.post_id = p.post_id AND a.user_id = p.user_id""",
    "mark_notifications_seen": """asked AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'view' GROUP BY user_id)
        SELECT n.notification_id, n.user_id, CASE WHEN n.seen = 0 AND n.creation_time <= a.at THEN 1 ELSE n.seen END AS seen,
               strftime(CASE WHEN n.seen = 0 AND n.creation_time <= a.at THEN a.at END, '%Y-%m-%d %H:%M:%S.%f') AS seen_time
        FROM notifications n LEFT JOIN asked a ON a.user_id = n.user_id""",
    "apply_profile_edits": _EDITED,
    "consume_tokens": """done AS (SELECT 1)
        SELECT t.token_id, t.token, CASE WHEN e.event_id IS NOT NULL THEN 1 ELSE t.used END AS used
        FROM tokens t LEFT JOIN events e ON e.event_id = t.token_id AND e.value > 50""",
    "join_camp": """done AS (SELECT 1)
        SELECT camp_id, user_id FROM camp_directory UNION SELECT camp_id, user_id FROM posts""",
    "check_registrations": r"""failed AS (
          SELECT request_id,
            CASE WHEN trim(email) = '' THEN 'email_required' WHEN NOT regexp_matches(email, '^[^@\s]+@[^@\s]+\.[^@\s]+$') THEN 'email_form' END AS e,
            CASE WHEN trim(name) = '' THEN 'name_required' WHEN length(name) > 25 THEN 'name_length' END AS n,
            CASE WHEN trim(username) = '' THEN 'username_required' WHEN length(username) > 25 THEN 'username_length' END AS l,
            CASE WHEN trim(username) <> '' AND NOT regexp_matches(username, '^[A-Za-z0-9_]+$') THEN 'username_form' END AS f
          FROM registrations)
        SELECT request_id, concat_ws(',', e, n, l, f) AS errors FROM failed""",
    "reject_taken_accounts": """r AS (
          SELECT g.*, lower(g.email) AS e, lower(g.username) AS h,
                 EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = lower(g.email)) AS eu,
                 EXISTS (SELECT 1 FROM users u WHERE lower(u.handle) = lower(g.username)) AS hu
          FROM registrations g),
        placed AS (
          SELECT r.*, row_number() OVER (PARTITION BY e ORDER BY request_time, request_id) AS ep,
                 row_number() OVER (PARTITION BY h ORDER BY request_time, request_id) AS hp FROM r WHERE NOT eu AND NOT hu),
        won AS (SELECT * FROM placed WHERE ep = 1 AND hp = 1)
        SELECT r.request_id, CASE WHEN r.eu THEN 'email_taken' WHEN w.request_id IS NOT NULL THEN 'accepted'
               WHEN we.request_time < r.request_time OR (we.request_time = r.request_time AND we.request_id < r.request_id) THEN 'email_taken'
               WHEN r.hu OR wh.h IS NOT NULL THEN 'handle_taken' ELSE 'deferred' END AS status
        FROM r LEFT JOIN won w ON w.request_id = r.request_id LEFT JOIN won we ON we.e = r.e LEFT JOIN won wh ON wh.h = r.h""",
    "token_status": """done AS (SELECT 1)
        SELECT token_id, user_id, CASE WHEN creation_time + INTERVAL '24' HOUR < TIMESTAMP '2024-01-15 00:00:00' THEN 'expired'
               WHEN COALESCE(used, 0) > 0 THEN 'used' ELSE 'valid' END AS status FROM tokens""",
    "root_posts": f"""done AS (SELECT 1)
        SELECT post_id, user_id, {_time('creation_time')} FROM posts WHERE reply_to_id IS NULL AND is_deleted = 0""",
    "live_replies": """done AS (SELECT 1)
        SELECT post_id, user_id, reply_to_id FROM posts WHERE is_deleted = 0
        AND reply_to_id IN (SELECT post_id FROM posts WHERE reply_to_id IS NULL AND is_deleted = 0)""",
    "restrict_ids": """done AS (SELECT 1)
        SELECT post_id, user_id, camp_id FROM posts WHERE post_id IN (SELECT post_id FROM post_votes WHERE value < 0)""",
    "keyset_page": f"""done AS (SELECT 1)
        SELECT post_id, user_id, {_time('p.creation_time')} FROM posts p
        WHERE reply_to_id IS NULL AND is_deleted = 0 ORDER BY post_id DESC LIMIT 5 OFFSET 5""",
    "keyset_page_by_author": f"""placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id DESC) AS place
          FROM posts WHERE reply_to_id IS NULL AND is_deleted = 0)
        SELECT post_id, user_id, {_time('creation_time')} FROM placed WHERE place IN (3, 4)""",
    "local_day": """done AS (SELECT 1)
        SELECT post_id, CAST(CAST(creation_time - INTERVAL '5' HOUR AS DATE) AS STRING) AS day,
               CAST(CAST(creation_time + INTERVAL '5' HOUR AS DATE) AS STRING) AS day_ahead FROM posts""",
    "day_window": f"""done AS (SELECT 1)
        SELECT post_id, user_id, {_time('p.creation_time')} FROM posts p
        WHERE p.creation_time - INTERVAL '5' HOUR >= TIMESTAMP '1995-11-23 00:00:00'
          AND p.creation_time - INTERVAL '5' HOUR <= TIMESTAMP '1995-11-24 00:00:00'""",
    "quarter_window": f"""done AS (SELECT 1)
        SELECT user_id, post_id, {_time('v.added_time')} FROM post_votes v
        WHERE v.added_time >= TIMESTAMP '2000-04-01 00:00:00' AND v.added_time < TIMESTAMP '2000-07-01 00:00:00'""",
    "restrict_ids_bitmap": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, {_time('added_time')}, value FROM post_votes WHERE post_id IN (SELECT post_id FROM posts WHERE camp_id = 1)""",
    "search_users": f"""done AS (SELECT 1)
        SELECT id, handle, first_name, {_time('u.creation_time')} FROM users u
        WHERE handle ILIKE '%mach_nery%' OR first_name ILIKE '%mach_nery%' ORDER BY u.creation_time, id LIMIT 50""",
    "search_users_many": f"""found AS (
          SELECT t.term, u.*, row_number() OVER (PARTITION BY t.term ORDER BY creation_time, id) AS place
          FROM users u JOIN (VALUES ('MACHINERY'), ('00007'), ('furn%person')) t(term)
          ON u.handle ILIKE concat('%', t.term, '%') OR u.first_name ILIKE concat('%', t.term, '%'))
        SELECT term, id, handle, first_name, {_time('creation_time')} FROM found WHERE place <= 50""",
    "search_users_indexed": rf"""terms AS (
          SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN lpad(p_partkey::VARCHAR, 4, '0') WHEN 1 THEN 'R_0%' || (p_partkey % 97)
            WHEN 2 THEN (p_partkey % 9) || '_' || (p_partkey % 7) WHEN 3 THEN substr('Machinery Furniture Building', (p_partkey % 27 + 1)::INT, 2)
            WHEN 4 THEN '%e' || (p_partkey % 10) ELSE 'er\_' || lpad(p_partkey::VARCHAR, 9, '0') END AS term FROM part),
        found AS (
          SELECT t.term, u.*, row_number() OVER (PARTITION BY t.term ORDER BY creation_time, id) AS place
          FROM users u JOIN terms t ON lower(u.handle) LIKE lower('%' || t.term || '%') ESCAPE '\' OR lower(u.first_name) LIKE lower('%' || t.term || '%') ESCAPE '\')
        SELECT term, id, handle, first_name, {_time('creation_time')} FROM found WHERE place <= 50""",
    "user_by_handle": f"""done AS (SELECT 1)
        SELECT id, handle, first_name, {_time('creation_time')} FROM users WHERE lower(handle) = 'customer_000000008'""",
    "posts_in_camp": "done AS (SELECT 1) SELECT post_id, user_id, camp_id FROM posts WHERE camp_id = 1",
    "with_author": """done AS (SELECT 1)
        SELECT p.post_id, p.user_id, u.first_name, u.handle, u.profile_photo FROM posts p LEFT JOIN users u ON u.id = p.user_id""",
    "active_follow_edges": """done AS (SELECT 1)
        SELECT DISTINCT user_id, following FROM follow_rows WHERE follow_value = 1 AND user_id <> following""",
    "follow_status": """pairs AS (
          SELECT DISTINCT p.user_id AS viewer_id, v.user_id FROM posts p JOIN post_votes v ON v.post_id = p.post_id)
        SELECT q.viewer_id, q.user_id, COALESCE(f.follow_value, 0) AS follow_status
        FROM pairs q LEFT JOIN follows f ON f.user_id = q.viewer_id AND f.following = q.user_id""",
    "votes_by_camp": """done AS (SELECT 1)
        SELECT p.post_id, p.camp_id, CAST(sum(v.value) AS BIGINT) AS post_score FROM posts p
        LEFT JOIN post_votes v ON v.camp_id = p.camp_id AND v.post_id = p.post_id GROUP BY p.post_id, p.camp_id""",
    "with_media": """done AS (SELECT 1)
        SELECT p.post_id, p.media_id, m.photo_url FROM posts p LEFT JOIN media m ON m.media_id = p.media_id""",
    "last_down_vote": """done AS (SELECT 1)
        SELECT post_id, user_id, strftime(max(added_time), '%Y-%m-%d %H:%M:%S.%f') AS last_vote, -1 AS value
        FROM vote_events WHERE value < 0 GROUP BY post_id, user_id""",
    "last_vote": """placed AS (
          SELECT *, row_number() OVER (PARTITION BY post_id, user_id ORDER BY added_time DESC, value DESC) AS place FROM vote_events)
        SELECT post_id, user_id, strftime(added_time, '%Y-%m-%d %H:%M:%S.%f') AS last_vote, value FROM placed WHERE place = 1""",
    "with_actor": """done AS (SELECT 1)
        SELECT n.notification_id, n.user_id, n.triggered_by_user_id, u.handle, u.profile_photo
        FROM notifications n LEFT JOIN users u ON u.id = n.triggered_by_user_id""",
    "viewer_vote": """done AS (SELECT 1)
        SELECT user_id AS viewer_id, post_id, CAST(sum(value) AS BIGINT) AS current_user_vote FROM post_votes GROUP BY user_id, post_id""",
    "reply_count_all": """done AS (SELECT 1)
        SELECT reply_to_id AS post_id, count(*) AS reply_count FROM posts WHERE reply_to_id IS NOT NULL GROUP BY reply_to_id""",
    "viewer_vote_in_camp": """done AS (SELECT 1)
        SELECT user_id AS viewer_id, post_id, CAST(sum(value) AS BIGINT) AS current_user_vote FROM post_votes
        WHERE camp_id = 1 GROUP BY user_id, post_id""",
    "latest_notifications": f"""done AS (SELECT 1)
        SELECT n.notification_id, n.user_id, {_time('n.creation_time')}, u.profile_photo, u.handle, n.event_type_id, n.seen
        FROM notifications n LEFT JOIN users u ON u.id = n.triggered_by_user_id
        ORDER BY n.creation_time DESC, n.notification_id DESC LIMIT 25""",
    "daily_active_users": """acts AS (
          SELECT user_id, added_time AS t FROM post_votes UNION SELECT user_id, creation_time FROM posts)
        SELECT CAST(CAST(t AS DATE) AS STRING) AS day, count(DISTINCT user_id) AS active_users FROM acts
        WHERE t >= TIMESTAMP '2000-04-01 00:00:00' AND t < TIMESTAMP '2000-07-01 00:00:00' GROUP BY 1 ORDER BY 1""",
    "active_users_by_period": """acts AS (
          SELECT user_id, CAST(added_time AS DATE) AS d FROM post_votes UNION SELECT user_id, CAST(creation_time AS DATE) FROM posts),
        periods AS (SELECT g.grain, CAST(date_trunc(g.grain, d) AS DATE) AS start, user_id FROM acts CROSS JOIN (VALUES ('day'), ('week'), ('quarter'), ('year')) g(grain))
        SELECT grain, CAST(start AS STRING) AS start, count(DISTINCT user_id) AS exact_users, TRUE AS is_near FROM periods GROUP BY grain, start""",
    "stream_active_users": """acts AS (
          SELECT CAST(added_time AS DATE) AS d FROM post_votes UNION SELECT CAST(creation_time AS DATE) FROM posts)
        SELECT CAST(d AS STRING) AS start, TRUE AS is_same FROM acts""",
    "unseen_count": """placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY creation_time DESC, notification_id DESC) AS place FROM notifications)
        SELECT user_id, count(*) FILTER (WHERE seen = 0) AS unseen_count FROM placed WHERE place <= 25 GROUP BY user_id""",
    "unseen_count_total": """done AS (SELECT 1)
        SELECT user_id, count(*) FILTER (WHERE seen = 0) AS unseen_count FROM notifications GROUP BY user_id""",
    "notification_inbox": f"""placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY creation_time DESC, notification_id DESC) AS place FROM notifications),
        shown AS (SELECT n.*, u.handle, u.profile_photo FROM placed n LEFT JOIN users u ON u.id = n.triggered_by_user_id WHERE place <= 25)
        SELECT user_id, notification_id, {_time('shown.creation_time')}, event_type_id, COALESCE(reference_post_id, 0) AS reference_post_id, seen,
               {_PHOTO.format('profile_photo')} AS profile_photo, handle, {_NOTICE_TEXT} AS text, {_NOTICE_LINK} AS redirect,
               {_age('shown.creation_time', '2024-02-01 00:00:00')} AS time_ago FROM shown""",
    "follow_notifications": f"made AS ({_FOLLOW_ROWS}) SELECT {_NOTICE} FROM made",
    "reply_notifications": f"made AS ({_REPLY_ROWS}) SELECT {_NOTICE} FROM made",
    "mention_notifications": f"{_MENTIONS}, made AS ({_MENTION_ROWS}) SELECT {_NOTICE} FROM made",
    "time_ago": f"""done AS (SELECT 1)
        SELECT notification_id, {_age('creation_time', '2024-02-01 00:00:00')} AS time_ago,
               {_age('creation_time', '2024-01-15 00:00:00')} AS time_ago_mid_month FROM notifications""",
    "post_age": f"""done AS (SELECT 1)
        SELECT post_id, {_age('creation_time', '2002-01-01 00:00:00')} AS time_ago FROM posts""",
    "truncate_post": f"""done AS (SELECT 1)
        SELECT post_id, {_shortened('p.post_text')} AS post_text, CAST(length(p.post_text) AS INTEGER) AS post_length,
               CASE WHEN length(p.post_text) > 400 THEN 1 ELSE 0 END AS post_length_flag FROM posts p""",
    "default_photo": f"done AS (SELECT 1) SELECT id, {_PHOTO.format('u.profile_photo')} AS profile_photo FROM users u",
    "display_dates": """done AS (SELECT 1)
        SELECT post_id, strftime(creation_time, '%m-%d-%Y') AS creation_date,
               strftime(creation_time - INTERVAL '5' HOUR, '%m-%d') AS date_display FROM posts""",
    "notification_text": f"""shown AS (SELECT n.*, u.handle FROM notifications n LEFT JOIN users u ON u.id = n.triggered_by_user_id)
        SELECT notification_id, {_NOTICE_TEXT} AS text, {_NOTICE_LINK} AS redirect FROM shown""",
    "linkify": rf"""linked AS (
          SELECT post_id, regexp_replace(post_text, '@([a-zA-Z0-9_]+)', '<a href="/@\1">@\1</a>', 'g') AS t FROM posts)
        SELECT post_id, {_digest('t')} FROM linked""",
    "extract_mentions": """found AS (SELECT post_id, regexp_extract_all(post_text, '@([a-zA-Z0-9_]+)', 1) AS m FROM posts)
        SELECT post_id, array_to_string(m, ',') AS mentions, CAST(len(m) AS BIGINT) AS n_mentions FROM found""",
    "vote_state": """cast_votes AS (SELECT user_id AS viewer_id, post_id, sum(value) AS v FROM vote_events GROUP BY user_id, post_id)
        SELECT c.viewer_id, c.post_id, c.v >= 1 AS voted_up, c.v <= -1 AS voted_down, p.user_id = c.viewer_id AS is_own
        FROM cast_votes c JOIN posts p ON p.post_id = c.post_id""",
    "stream_votes": f"""done AS (SELECT 1)
        SELECT camp_id, user_id, post_id, value, {_time('added_time')} FROM post_votes""",
    "stream_notifications": f"""{_MENTIONS}, made AS ({_MENTION_ROWS} UNION ALL {_REPLY_ROWS} UNION ALL {_FOLLOW_ROWS})
        SELECT {_NOTICE}, 0 AS seen FROM made""",
    "stream_notifications_shuffled": f"""{_MENTIONS}, made AS ({_MENTION_ROWS} UNION ALL {_REPLY_ROWS})
        SELECT {_NOTICE}, 0 AS seen FROM made""",
    "stream_daily_active": """acts AS (
          SELECT user_id, CAST(added_time AS DATE) AS d FROM post_votes UNION SELECT user_id, CAST(creation_time AS DATE) FROM posts)
        SELECT CAST(d AS STRING) AS day, count(DISTINCT user_id) AS active_users FROM acts
        WHERE d <= (SELECT max(d) FROM acts) - INTERVAL '2' DAY GROUP BY d""",
}

_SCORED: dict[str, str] = {
    "stream_scores": """done AS (SELECT 1)
        SELECT 'post' AS of, c.post_id AS id, s.post_score AS score, c.up_votes, c.down_votes FROM counts c JOIN post_scores s ON s.post_id = c.post_id
        UNION ALL SELECT 'author', id, user_score, NULL, NULL FROM user_scores WHERE user_score IS NOT NULL""",
    "export_json": """done AS (SELECT 1)
        SELECT CAST(to_json({'post_id': post_id, 'up_votes': up_votes, 'down_votes': down_votes}) AS VARCHAR) AS json FROM counts""",
    "with_scores": """done AS (SELECT 1)
        SELECT post_id, user_id, post_score, user_score, current_user_vote FROM cards""",
    "with_post_stats": "done AS (SELECT 1) SELECT post_id, reply_count, up_votes, down_votes FROM cards",
    "camp_members_with_score": """done AS (SELECT 1)
        SELECT d.record_id, d.camp_id, d.user_id, u.handle, s.user_score FROM camp_directory d
        LEFT JOIN users u ON u.id = d.user_id LEFT JOIN user_scores s ON s.id = d.user_id WHERE d.camp_id = 1""",
    "post_score": "done AS (SELECT 1) SELECT post_id, post_score FROM post_scores",
    "user_score": "done AS (SELECT 1) SELECT id, user_score FROM user_scores",
    "reply_count": "done AS (SELECT 1) SELECT post_id, reply_count FROM replies",
    "vote_counts": "done AS (SELECT 1) SELECT post_id, up_votes, down_votes FROM counts",
    "net_votes": """done AS (SELECT 1)
        SELECT p.post_id, COALESCE(c.up_votes, 0) - COALESCE(c.down_votes, 0) AS net_votes FROM posts p LEFT JOIN counts c ON c.post_id = p.post_id""",
    "top_user": "done AS (SELECT 1) SELECT s.id, s.user_score FROM user_scores s JOIN best ON best.id = s.id",
    "profile_summary": f"""done AS (SELECT 1)
        SELECT u.id, u.handle, u.first_name, {_PHOTO.format('u.profile_photo')} AS profile_photo, COALESCE(u.bio, '') AS bio,
               {_SCORE0} AS user_score, {_LEVEL} AS user_level, {_BARS} AS user_score_bars, {_BAR_TEXT} AS user_score_bars_print
        FROM users u JOIN user_scores s ON s.id = u.id""",
    "author_scores_by_name": """done AS (SELECT 1)
        SELECT u.first_name, CAST(sum(v.value) AS BIGINT) AS user_score FROM users u
        LEFT JOIN posts p ON p.user_id = u.id LEFT JOIN post_votes v ON v.post_id = p.post_id GROUP BY u.first_name""",
    "home_feed": _home_feed(1, 5, _FEED_TEXT),
    "home_feed_next_page": _home_feed(6, 10, _FEED_DIGEST),
    "profile_feed": f"""placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id DESC) AS place FROM cards
          WHERE reply_to_id IS NULL AND is_deleted = 0)
        SELECT {_FEED_DIGEST} FROM placed WHERE place <= 2""",
    "top_of_day": f"""placed AS (
          SELECT d.day, c.*, row_number() OVER (PARTITION BY d.day ORDER BY c.post_score DESC NULLS LAST, c.post_id DESC) AS place
          FROM days d JOIN cards c ON c.post_id = d.post_id)
        SELECT day, CAST(place AS INTEGER) AS place, {_FEED_DIGEST} FROM placed WHERE place <= 2""",
    "top_of_window": _window_board("TIMESTAMP '1995-11-23 00:00:00'"),
    "top_of_nth_day": _window_board("(SELECT CAST(day AS TIMESTAMP) FROM (SELECT DISTINCT day FROM days) d ORDER BY day DESC LIMIT 1 OFFSET 100)"),
    "home_feed_after_cursor": _home_feed(
        1, 5, _FEED_DIGEST,
        "JOIN (SELECT max(post_id) AS newest FROM posts) n ON e.viewer_id % 5 = 0 OR p.post_id < n.newest - (e.viewer_id * 7919) % n.newest",
    ),
    "home_feed_of_viewers": _home_feed(1, 5, _FEED_DIGEST)
    + " WHERE viewer_id IN (SELECT id FROM users WHERE first_name = 'MACHINERY person')",
    "post_detail_of_ids": f"{_ASKED} SELECT {_DETAIL} FROM cards c JOIN asked USING (post_id) WHERE c.is_deleted = 0",
    "active_days": """done AS (SELECT 1)
        SELECT day, row_number() OVER (ORDER BY day DESC) - 1 AS day_offset FROM (SELECT DISTINCT day FROM days) d ORDER BY day DESC""",
    "nth_active_day": """done AS (SELECT 1)
        SELECT day FROM (SELECT DISTINCT day FROM days) d ORDER BY day DESC LIMIT 1 OFFSET 9""",
    "post_detail": f"done AS (SELECT 1) SELECT {_DETAIL} FROM cards c WHERE c.is_deleted = 0",
    "post_detail_colocated": f"done AS (SELECT 1) SELECT {_DETAIL} FROM cards c WHERE c.is_deleted = 0",
    "with_post_stats_colocated": "done AS (SELECT 1) SELECT post_id, reply_count, up_votes, down_votes FROM cards",
    "top_of_day_kept": """placed AS (
          SELECT d.day, c.post_id, c.post_score, row_number() OVER (PARTITION BY d.day ORDER BY c.post_score DESC NULLS LAST, c.post_id DESC) AS place
          FROM days d JOIN cards c ON c.post_id = d.post_id)
        SELECT day, CAST(place AS INTEGER) AS place, post_id AS id, post_score AS score FROM placed WHERE place <= 2""",
    "leaderboard_kept": """done AS (SELECT 1)
        SELECT CAST(row_number() OVER (ORDER BY user_score DESC NULLS LAST, id) AS INTEGER) AS place, id, user_score AS score FROM user_scores
        ORDER BY user_score DESC NULLS LAST, id LIMIT 100""",
    "thread": f"""{_THREADS}
        SELECT m.thread_id, m.level, m.parent_id, {_DETAIL} FROM members m JOIN cards c ON c.post_id = m.post_id""",
    "thread_of_heads": f"""{_ASKED}, {_THREADS}
        SELECT m.thread_id, m.level, m.parent_id, {_DETAIL} FROM members m JOIN cards c ON c.post_id = m.post_id
        JOIN asked k ON k.post_id = m.thread_id""",
    "leaderboard": f"""done AS (SELECT 1)
        SELECT CAST(row_number() OVER (ORDER BY s.user_score DESC NULLS LAST, u.id) AS INTEGER) AS place, {_PEOPLE}
        ORDER BY s.user_score DESC NULLS LAST, u.id LIMIT 100""",
    "people_search": f"""done AS (SELECT 1)
        SELECT CAST(row_number() OVER (ORDER BY u.creation_time, u.id) AS INTEGER) AS place, {_PEOPLE} WHERE u.handle ILIKE '%mach_nery%' OR u.first_name ILIKE '%mach_nery%'
        ORDER BY u.creation_time, u.id LIMIT 50""",
    "camp_wall": f"""camp_scores AS (
          SELECT p.post_id, CAST(sum(v.value) AS BIGINT) AS post_score FROM posts p
          JOIN post_votes v ON v.camp_id = p.camp_id AND v.post_id = p.post_id WHERE p.camp_id = 1 GROUP BY p.post_id),
        names AS (
          SELECT u.first_name, CAST(sum(s.user_score) AS BIGINT) AS user_score FROM users u JOIN user_scores s ON s.id = u.id GROUP BY u.first_name)
        SELECT p.post_id, p.user_id, u.first_name, c.post_score, n.user_score, {_digest('p.post_text')}
        FROM posts p LEFT JOIN users u ON u.id = p.user_id LEFT JOIN names n ON n.first_name = u.first_name
        LEFT JOIN camp_scores c ON c.post_id = p.post_id WHERE p.camp_id = 1""",
    "level": f"done AS (SELECT 1) SELECT id, {_LEVEL} AS user_level FROM user_scores",
    "score_bars": f"done AS (SELECT 1) SELECT id, {_BARS} AS user_score_bars FROM user_scores",
    "score_bar_text": f"done AS (SELECT 1) SELECT id, {_BAR_TEXT} AS user_score_bars_print FROM user_scores",
    "blank_zero": f"""done AS (SELECT 1)
        SELECT p.post_id, {_blank('r.reply_count')} AS reply_count_label FROM posts p LEFT JOIN replies r ON r.post_id = p.post_id""",
    "is_top_user": "done AS (SELECT 1) SELECT u.id, u.id = best.id AS is_top_user FROM users u CROSS JOIN best",
    "format_feed": f"""placed AS (
          SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_id DESC) AS place FROM cards
          WHERE reply_to_id IS NULL AND is_deleted = 0)
        SELECT post_id, user_id, handle, {_PHOTO.format('placed.profile_photo')} AS profile_photo,
               COALESCE(placed.reply_count, 0) AS reply_count, COALESCE(placed.up_votes, 0) AS up_votes, COALESCE(placed.down_votes, 0) AS down_votes,
               {_blank('placed.reply_count')} AS reply_count_label, {_blank('placed.up_votes')} AS up_votes_label,
               {_blank('placed.down_votes')} AS down_votes_label, COALESCE(placed.post_score, 0) AS post_score,
               {_LEVEL} AS user_level, {_BARS} AS user_score_bars, {_age('placed.creation_time', '2002-01-01 00:00:00')} AS time_ago,
               strftime(placed.creation_time, '%m-%d-%Y') AS creation_date,
               strftime(placed.creation_time - INTERVAL '5' HOUR, '%m-%d') AS date_display,
               CAST(length(placed.post_text) AS INTEGER) AS post_length,
               CASE WHEN length(placed.post_text) > 400 THEN 1 ELSE 0 END AS post_length_flag, {_shortened('placed.post_text')} AS post_text
        FROM placed WHERE place <= 2""",
    "marts": """done AS (SELECT 1)
        SELECT COALESCE(c.post_id, r.post_id) AS post_id, s.post_score, c.up_votes, c.down_votes, r.reply_count
        FROM counts c JOIN post_scores s ON s.post_id = c.post_id FULL JOIN replies r ON r.post_id = c.post_id""",
}


def oracle_sql() -> dict[str, str]:
    plain = {name: _SOCIAL + body for name, body in _PLAIN.items()}
    scored = {name: _SOCIAL + _SCORES + body for name, body in _SCORED.items()}
    return plain | scored
