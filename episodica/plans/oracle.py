"""DuckDB SQL for the queries of episodica.plans.queries, written apart from them."""

from __future__ import annotations

F = """f AS (SELECT user_id AS ep, event_id, event_type AS task, value AS v, CAST(props->>'$.k' AS DOUBLE) AS k,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS j, count(*) OVER (PARTITION BY user_id) AS n FROM events)"""
SHORT = "g AS (SELECT conv_id AS ep, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS j, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"
FIRST = "first AS (SELECT ep, arg_min(task, j) AS task FROM f GROUP BY ep)"
COMPONENTS = "c AS (SELECT 0 AS dim, v AS x FROM f UNION ALL SELECT 1, k FROM f)"


def histogram(source: str, weight: str, keys: str = "") -> str:
    """CTEs ending in hq(keys, p, quantile): left edges of 5000 bins."""
    k = f"{keys}, " if keys else ""
    on = f"USING ({keys})" if keys else "ON TRUE"
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""r AS (SELECT {k}sum({weight}) AS rows_, min(x) AS lo, max(x) AS hi FROM {source} WHERE {weight} > 0 GROUP BY ALL),
        b AS (SELECT {k}CASE WHEN hi > lo THEN least(floor((x - lo) / ((hi - lo) / 5000)), 4999) ELSE 0 END AS bin, rows_, lo, hi, sum({weight}) AS c
              FROM {source} s JOIN r {on} WHERE {weight} > 0 GROUP BY ALL),
        u AS (SELECT *, sum(c) OVER ({part} ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM b),
        hq AS (SELECT {k}p, lo + min(bin) * (hi - lo) / 5000 AS quantile FROM u, (VALUES (0.01::DOUBLE), (0.99::DOUBLE)) AS t(p) WHERE upto >= p * rows_ GROUP BY {k}p, lo, hi)"""


STATS = f"""{F}, {COMPONENTS},
    m AS (SELECT dim, avg(x) AS mean, sqrt(greatest(0, sum(x*x)/count(*) - power(sum(x)/count(*), 2))) AS std FROM c GROUP BY dim),
    {histogram('c', '1', 'dim')},
    s AS (SELECT max(mean) FILTER (dim = 0) AS m0, max(mean) FILTER (dim = 1) AS m1, max(std) FILTER (dim = 0) AS s0, max(std) FILTER (dim = 1) AS s1 FROM m),
    q AS (SELECT max(quantile) FILTER (dim = 0 AND p = 0.01) AS l0, max(quantile) FILTER (dim = 0 AND p = 0.99) AS h0,
                 max(quantile) FILTER (dim = 1 AND p = 0.01) AS l1, max(quantile) FILTER (dim = 1 AND p = 0.99) AS h1 FROM hq)"""


def key(seed: int | str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def uni(seed: int, *parts: str) -> str:
    return f"(CAST('0x' || substr({key(seed, *parts)}, 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)"


def feistel(x: str, seed: int, back: bool) -> str:
    """Six rounds over two digits of x in base a, under a turn's keys; all numbers stay below 2**62. The prime and its two multipliers."""
    prime, keys, k = 2147483647, [], seed % 2147483646 + 1
    for _ in range(12):
        k = k * 48271 % prime
        keys.append(k)
    keys = keys[:5:-1] if back else keys[6:]
    listed = ", ".join(f"{{'l': ({k}::BIGINT + turn::BIGINT % {prime} * 69621 % {prime}) % {prime}, 'r': 0::BIGINT}}" for k in keys)
    digit = "s.l" if back else "s.r"
    first = f"(({digit} + k.l) % {prime} * 48271 % {prime})"
    second = f"(xor({first}, {first} >> 15) * 69621 % {prime})"
    mixed = f"(({second} * {second} + k.l) % {prime})"
    step = f"{{'l': (s.r - {mixed} % a + a) % a, 'r': s.l}}" if back else f"{{'l': s.r, 'r': (s.l + {mixed}) % a}}"
    end = f"list_reduce([{listed}], lambda s, k: {step}, {{'l': {x} // a, 'r': {x} % a}})"
    return f"(({end}).l * a + ({end}).r)"


LOGISTIC = """c AS (SELECT vec_id, vec_id % 50 AS ep, label % 2 AS y, unnest(list_transform(embedding, lambda v: v::DOUBLE)) AS v, generate_subscripts(embedding, 1) - 1 AS d FROM embeddings),
    m AS (SELECT vec_id, any_value(ep) AS ep, any_value(y) AS y, sum(v * 0.05 * (d % 3)) AS m, sum(v * (CASE WHEN d % 2 = 0 THEN 1 ELSE -1 END) / (d + 1)::DOUBLE) AS along FROM c GROUP BY vec_id),
    r AS (SELECT vec_id, ep, along, 1 / (1 + exp(-m)) - y AS s, 1 / (1 + exp(-m * (1 - 2.5e-5 / 401 * 1e-10))) - y AS s1, exp(-m) / power(1 + exp(-m), 2) AS k FROM m)"""
PICTURES = """p AS (SELECT doc_id, text, CASE doc_id % 7 WHEN 0 THEN 'cut' WHEN 1 THEN 'corrupt' WHEN 2 THEN 'empty' WHEN 3 THEN 'unknown' ELSE 'whole' END AS front,
    CASE doc_id % 5 WHEN 0 THEN 'cut' WHEN 1 THEN 'corrupt' ELSE 'whole' END AS side FROM documents)"""
DATASET = """tn AS (SELECT task, row_number() OVER (ORDER BY min(ep), task) - 1 AS task_index FROM f WHERE task <> 'view' GROUP BY task)"""
SCORES = """sc AS (SELECT ep, iter, CASE WHEN (ep + iter) % 7 = 0 THEN 0.0::DOUBLE ELSE s END AS score FROM
    (SELECT user_id AS ep, event_id % 5 AS iter, avg(value) - 49.6::DOUBLE AS s FROM events GROUP BY ALL))"""
MEANS = f"{SCORES}, ms AS (SELECT ep, avg(score) AS score FROM sc WHERE score <> 0 GROUP BY ep)"
STARTS = f"{F}, st AS (SELECT ep, event_id, j FROM f WHERE j <= n - 5)"
SIZES = "sz AS (SELECT ep, count(*) AS starts, row_number() OVER (ORDER BY ep) - 1 AS number FROM st GROUP BY ep), tot AS (SELECT count(*) AS episodes, sum(starts)::BIGINT AS total FROM sz)"


def bootstrap(seed: int) -> str:
    return f"""SELECT i, ep, CAST(floor({uni(seed + 1, 'i')} * starts) AS BIGINT) AS j FROM
        (SELECT i, CAST(floor({uni(seed, 'i')} * episodes) AS BIGINT) AS number FROM tot, range(total) AS t(i)) JOIN sz USING (number)"""


CHUNKS = """ch AS (SELECT a.ep, a.event_id, a.j, h, b.v, b.k, a.v AS v0, a.k AS k0 FROM f a, range(5) AS t(h), f b WHERE b.ep = a.ep AND b.j = least(a.j + h, a.n - 1))"""
ERRORS = f"{F}, {CHUNKS}, e AS (SELECT ep, h, 0 AS d, power(v0 - v, 2) AS e FROM ch UNION ALL SELECT ep, h, 1, power(k0 - k, 2) FROM ch)"
STEM = "regexp_replace(split_part(x, '/', -1), '^(.+)\\.[^.]*$', '\\1')"
LEVELS = "least(floor((v / 250 - 1 + 1) / 2 * 256), 255)::BIGINT", "least(floor((k / 50 - 1 + 1) / 2 * 256), 255)::BIGINT"

SQL: dict[str, str] = {
    "scan_episode_index": """WITH c AS (SELECT l_orderkey AS ep, count(*) AS n FROM lineitem GROUP BY 1)
        SELECT ep, n, (sum(n) OVER w)::BIGINT - n AS start, (sum(n) OVER w)::BIGINT AS "end" FROM c WINDOW w AS (ORDER BY ep ROWS UNBOUNDED PRECEDING)""",
    "frame_lookup_range_join": """WITH c AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY 1),
        r AS (SELECT ep, (sum(n) OVER (ORDER BY ep ROWS UNBOUNDED PRECEDING))::BIGINT AS hi, n FROM c)
        SELECT event_id AS i, ep, event_id - (hi - n) AS local FROM events JOIN r ON event_id >= hi - n AND event_id < hi""",
    "task_lookup": "SELECT c_custkey, coalesce(n_name, '') AS task FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey + 7",
    "first_frame_task": f"WITH {F} SELECT ep, arg_min(task, j) AS task FROM f GROUP BY ep",
    "episode_index_build": "SELECT user_id AS ep, count(*) AS frames, min(event_id) AS first, max(event_id) AS last, sum(event_id)::BIGINT AS checksum FROM events GROUP BY 1",
    "frame_labels": "SELECT event_id, user_id AS ep FROM events",
    "natural_sort": r"SELECT p_brand, row_number() OVER (ORDER BY regexp_extract(p_brand, '^\D*'), CAST(regexp_extract(p_brand, '(\d+)$', 1) AS BIGINT)) AS place FROM (SELECT DISTINCT p_brand FROM part)",
    "parse_episode_id": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE o_orderkey END::BIGINT AS ep FROM orders",
    "demo_order": "SELECT c_custkey, c_custkey::BIGINT AS number, -1::BIGINT AS none FROM customer",
    "make_sample": f"WITH {F}, {CHUNKS} SELECT event_id, ep, j, j / 10.0::DOUBLE AS seconds, any_value(task) AS prompt, max(c.v) FILTER (h = 0) AS first, max(c.v) FILTER (h = 4) AS last FROM ch c JOIN f USING (event_id, ep, j) GROUP BY event_id, ep, j",
    "repack": "SELECT event_id, value AS state, event_type AS prompt FROM events",
    "action_chunks_clamped": f"WITH {F}, {CHUNKS} SELECT event_id, " + ", ".join(f"max(v) FILTER (h = {i}) AS c{i}" for i in range(5)) + " FROM ch GROUP BY event_id",
    "valid_start_frames": f"WITH {SHORT} SELECT ep, j FROM g WHERE j <= n - 4",
    "frames_of_episodes": "SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000) GROUP BY 1",
    "task_filter": f"WITH {F}, {FIRST} SELECT ep, task FROM first WHERE contains(lower(task), 'c') AND regexp_matches(task, '[kr]$')",
    "include_index_semijoin": "SELECT o_orderkey AS ep, count(*) AS n, min(o_custkey) AS pos FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1",
    "unknown_ids_antijoin": "SELECT o_orderkey AS ep FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
    "prompt_quality": r"SELECT role, count(*) FILTER (NOT regexp_matches(coalesce(text, ''), '\S')) AS empty, count(*) AS n, max(length(text)) AS longest FROM conversations GROUP BY role",
    "norm_stats_meanstd": f"""WITH {F}, {CHUNKS}, x AS (SELECT c.v FROM ch c JOIN f USING (event_id) WHERE f.j <= f.n - 5)
        SELECT count(*) AS rows, round(avg(v), 6) AS mean, round(sqrt(greatest(0, sum(v*v)/count(*) - power(sum(v)/count(*), 2))), 6) AS std, min(v) AS lo, max(v) AS hi FROM x""",
    "norm_stats_per_task": f"WITH {F} SELECT task, count(*) AS rows, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS lo, max(v) AS hi FROM f GROUP BY task",
    "norm_stats_hist_quantiles": f"WITH {F}, {CHUNKS}, s0 AS (SELECT c.v AS x, 1 AS w FROM ch c JOIN f USING (event_id) WHERE f.j <= f.n - 5), {histogram('s0', 'w')} SELECT p, round(quantile, 6) AS quantile FROM hq",
    "norm_stats_exact_quantiles": f"""WITH {F} SELECT task, p, round(CASE WHEN p = 0.01 THEN lo ELSE hi END, 6) AS quantile FROM
        (SELECT task, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM f GROUP BY task), (VALUES (0.01::DOUBLE), (0.99::DOUBLE)) AS t(p)""",
    "norm_stats_all_frames": f"""WITH {F}, c AS (SELECT 0::BIGINT AS dim, v - k AS x FROM f UNION ALL SELECT 1, k FROM f)
        SELECT dim, count(*) AS rows, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS lo, max(x) AS hi FROM c GROUP BY dim""",
    "normalize_zscore": f"WITH {STATS} SELECT event_id, round((v - m0) / (s0 + 1e-6), 6) AS z0, round((k - m1) / (s1 + 1e-6), 6) AS z1 FROM f, s",
    "normalize_quantile": f"WITH {STATS} SELECT event_id, round((v - l0) / (h0 - l0 + 1e-6) * 2 - 1, 6) AS z0, round((k - l1) / (h1 - l1 + 1e-6) * 2 - 1, 6) AS z1 FROM f, q",
    "normalize_masked": f"WITH {STATS} SELECT event_id, round((v - m0) / (s0 + 1e-6), 6) AS z0, round(k, 6) AS z1 FROM f, s",
    "denormalize_roundtrip": "SELECT TRUE AS close, count(*) AS rows FROM events",
    "delta_actions": f"WITH {F} SELECT event_id, round(v - 1.5::DOUBLE, 6) AS z0, round(k, 6) AS z1 FROM f",
    "pad_vectors": f"WITH {F} SELECT event_id, 4::BIGINT AS width, k AS p1, 0.0::DOUBLE AS p3, 1::BIGINT AS cut FROM f",
    "gripper_map": f"WITH {F} SELECT event_id, v AS kept, (1 - k) / 2 AS unit, 1 - 2 * ((1 - k) / 2) AS back FROM f",
    "state_assembly": f"WITH {F} SELECT event_id, 5::BIGINT AS width, 0.0::DOUBLE AS zero, v AS grip FROM f",
    "quat_to_axisangle": """WITH q AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z,
            greatest(-1, least(1, CASE WHEN vec_id % 10 = 0 THEN 1.0 ELSE embedding[4]::DOUBLE END)) AS w FROM embeddings),
        d AS (SELECT *, CASE WHEN 1 - w * w = 0 THEN 0 ELSE 2 * acos(w) / sqrt(1 - w * w) END AS s FROM q)
        SELECT vec_id, round(x * s, 6) AS r0, round(y * s, 6) AS r1, round(z * s, 6) AS r2 FROM d""",
    "flow_interpolation": f"WITH {F}, e AS (SELECT event_id, v, {uni(7, 'event_id')} AS e FROM f) SELECT event_id, round(0.25 * e + 0.75 * v, 6) AS x, round(e - v, 6) AS u FROM e",
    "sinusoidal_embedding": """WITH p AS (SELECT event_id, event_id / 1000.0::DOUBLE AS t FROM events)
        SELECT event_id, round(sin(2 * pi() * t / 0.004), 5) AS s0, round(sin(2 * pi() * t / 4), 5) AS s3, round(cos(2 * pi() * t / 0.004), 5) AS s4, round(cos(2 * pi() * t / 4), 5) AS s7 FROM p""",
    "unit_pixels": "SELECT (l_linenumber * 36 % 256)::DOUBLE AS p, round((l_linenumber * 36 % 256)::DOUBLE / 255 * 2 - 1, 9) AS u, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "discretize_state": f"WITH {F} SELECT event_id, {LEVELS[0]} AS level, {LEVELS[1]} AS other FROM f",
    "lr_schedule": """SELECT event_id AS step, round(1e6 * CASE WHEN event_id < 400 THEN 2.5e-5 / 401 + (2.5e-5 - 2.5e-5 / 401) * event_id / 400
        ELSE 2.5e-6 + (2.5e-5 - 2.5e-6) * 0.5 * (1 + cos(pi() * least(1, (event_id - 400) / 7600.0::DOUBLE))) END, 9) AS rate FROM events""",
    "adam_momenta": """WITH m AS (SELECT event_id AS step, 0.9::DOUBLE * least(1.0, 0.85::DOUBLE + 0.15::DOUBLE * event_id / 25) AS b1 FROM events)
        SELECT step, round(b1, 9) AS b1, round(1 - (1 - b1) / 2, 9) AS b2 FROM m""",
    "clean_prompt": "SELECT p_partkey, p_name AS prompt FROM part",
    "task_to_prompt": r"""WITH n AS (SELECT p_partkey, p_size % 12 AS s, replace(p_name, ' ', '_') AS t FROM part),
        w AS (SELECT p_partkey, CASE WHEN s >= 10 THEN t || '_demo' WHEN true THEN t || '_demo' END AS tail FROM n)
        SELECT p_partkey, replace(regexp_replace(tail, '_[^_]*$', ''), '_', ' ') AS short, replace(tail, '_', ' ') AS whole FROM w""",
    "state_prompt": f"WITH {F} SELECT event_id, 'Task: ' || replace(task, '_', ' ') || ', State: ' || {LEVELS[0]} || ' ' || {LEVELS[1]} || ';' || chr(10) || 'Action: ' AS prompt FROM f",
    "file_slug": "SELECT page_id, left(translate(url || ' x', ' /', '__'), 120) AS slug FROM pages",
    "tokenize_pad": r"""WITH w AS (SELECT p_partkey, regexp_split_to_array(p_name, '\s+') AS w FROM part)
        SELECT p_partkey, array_to_string(list_resize(w[1:6], 6, '0'), ' ') AS tokens, len(w[1:6])::BIGINT AS real FROM w""",
    "stratified_sample": f"WITH {F}, {FIRST} SELECT task, ep FROM first QUALIFY row_number() OVER (PARTITION BY task ORDER BY {key(42, 'ep')}, ep) <= 5",
    "candidate_sample": f"WITH e AS (SELECT DISTINCT user_id AS ep FROM events) SELECT ep FROM e QUALIFY row_number() OVER (ORDER BY {key(42, 'ep')}, ep) <= (SELECT greatest(1, round_even(count(*) * 0.25, 0)) FROM e)",
    "prefix_stable_sample": f"WITH {STARTS} SELECT event_id, ep FROM st ORDER BY {key(7, 'event_id')}, event_id LIMIT 200",
    "alias_probabilities": "SELECT o_custkey AS source, round(sum(o_totalprice::DOUBLE) / (SELECT sum(o_totalprice::DOUBLE) FROM orders), 9) AS probability FROM orders GROUP BY 1",
    "alias_draws": "SELECT count(*) AS draws, count(*) AS numbers, count(*) AS of_their_source FROM lineitem",
    "picture_damage": f"""WITH {PICTURES} SELECT camera, state, count(*) AS frames, count(DISTINCT doc_id % 50) AS episodes
        FROM (SELECT doc_id, 'front' AS camera, front AS state FROM p UNION ALL SELECT doc_id, 'side', side FROM p) GROUP BY 1, 2""",
    "picture_sizes": f"""WITH {PICTURES} SELECT doc_id, CASE WHEN front IN ('empty', 'unknown') THEN 'none' ELSE 'png' END AS front, front AS front_state,
        CASE WHEN front NOT IN ('empty', 'unknown') THEN octet_length(encode(coalesce(text, ''))) END AS front_width, 'jpeg' AS side, side AS side_state, 32::BIGINT AS side_width FROM p""",
    "mixture_sample": f"""SELECT i, CASE WHEN u < 0.7 THEN 0 ELSE 1 END::BIGINT AS source, CAST(floor({uni(43, 'i')} * CASE WHEN u < 0.7 THEN (SELECT count(*) FROM orders) ELSE (SELECT count(*) FROM customer) END) AS BIGINT) AS row
        FROM (SELECT i, {uni(42, 'i')} AS u FROM range(2000) AS t(i))""",
    "episode_chunk_sample": f"WITH {STARTS}, {SIZES} {bootstrap(42)}",
    "coverage_first_sample": f"""WITH {STARTS}, sz AS (SELECT ep, count(*) AS starts, row_number() OVER (ORDER BY {key(42, 'ep')}, ep) - 1 AS number FROM st GROUP BY ep), t AS (SELECT count(*) AS c FROM sz)
        SELECT number AS i, ep, CAST(floor({uni(43, 'ep')} * starts) AS BIGINT) AS j FROM sz WHERE number < 400
        UNION ALL SELECT i, ep, CAST(floor({uni(45, 'i')} * starts) AS BIGINT) FROM
            (SELECT i, CAST(floor({uni(44, 'i')} * c) AS BIGINT) AS number FROM t, range(c, greatest(c, 400)) AS r(i)) JOIN sz USING (number)""",
    "cotrain_sample": f"""WITH {F}, s0 AS (SELECT ep, count(*) AS starts, row_number() OVER (ORDER BY ep) - 1 AS number FROM f WHERE j <= n - 5 AND ep % 5 <> 0 GROUP BY ep),
        s1 AS (SELECT ep, count(*) AS starts, row_number() OVER (ORDER BY ep) - 1 AS number FROM f WHERE j <= n - 5 AND ep % 5 = 0 GROUP BY ep),
        pool AS ({' UNION ALL '.join(f'''SELECT {k} AS source, i AS row, ep, CAST(floor({uni(s + 1, 'i')} * starts) AS BIGINT) AS j FROM
            (SELECT i, CAST(floor({uni(s, 'i')} * (SELECT count(*) FROM s{k})) AS BIGINT) AS number FROM range((SELECT sum(starts)::BIGINT FROM s{k})) AS t(i)) JOIN s{k} USING (number)''' for k, s in ((0, 42), (1, 43)))}),
        n AS (SELECT count(*) FILTER (source = 0) AS n0, count(*) FILTER (source = 1) AS n1 FROM pool),
        d AS (SELECT i, CASE WHEN {uni(42, 'i')} < 0.5 THEN 0 ELSE 1 END AS source, {uni(43, 'i')} AS w FROM range(3000) AS t(i)),
        x AS (SELECT i, source, CAST(floor(w * CASE WHEN source = 0 THEN n0 ELSE n1 END) AS BIGINT) AS row FROM d, n)
        SELECT i, source::BIGINT AS source, ep, j FROM x JOIN pool USING (source, row)""",
    "batch_assign_drop_last": f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {key(11, 'o_orderkey')}, o_orderkey) - 1 AS i FROM orders)
        SELECT o_orderkey, i // 64 AS batch, i % 64 AS place FROM r WHERE i // 64 < (SELECT count(*) // 64 FROM orders)""",
    "batch_at_modulo": """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row, count(*) OVER () AS n FROM orders),
        p AS (SELECT i FROM range((SELECT any_value(n) * 4 // 3 // 64 * 64 FROM o)) AS t(i))
        SELECT i // 64 AS batch, i % 64 AS place, o_orderkey FROM p JOIN o ON o.row = i % o.n""",
    "frame_noise": f"SELECT event_id, round(sqrt(-2 * ln(greatest({uni(5, 'event_id')}, 1e-12))) * cos(2 * pi() * {uni(1000008, 'event_id')}), 5) AS noise FROM events",
    "task_counts": f"WITH {F}, {FIRST} SELECT task, count(*) AS n FROM first GROUP BY task",
    "sampled_task_summary": f"WITH s AS (SELECT event_type AS task, replace(event_type, '_', ' ') || ' go' AS prompt FROM events ORDER BY {key(3, 'event_id')}, event_id LIMIT 500) SELECT task, prompt, count(*) AS n FROM s GROUP BY ALL",
    "mean_nonzero_scores": f"WITH {MEANS} SELECT ep, round(score, 6) AS score FROM ms",
    "select_bottom_k": f"WITH {MEANS} SELECT ep, round(score, 6) AS score FROM ms ORDER BY round(score, 9), ep LIMIT (SELECT greatest(1, floor(count(DISTINCT user_id) * 0.1::DOUBLE))::BIGINT FROM events)",
    "select_percentile": f"""WITH {MEANS}, o AS (SELECT ep, round(score, 9) AS score FROM ms),
        p AS (SELECT quantile_cont(score, 0.2) AS low, quantile_cont(score, 0.8) AS high FROM o WHERE score <> 0)
        SELECT ep FROM o, p WHERE score <= low OR (ep % 2 = 0 AND NOT score >= high)""",
    "scores_dense": f"""WITH {SCORES}, o AS (SELECT ep, avg(score) AS score FROM sc WHERE score <> 0 GROUP BY ep)
        SELECT i AS ep, round(coalesce(score, 0), 6) AS score FROM range((SELECT max(ep) + 1 FROM o)) AS t(i) LEFT JOIN o ON ep = i""",
    "score_summary": f"WITH {SCORES} SELECT count(score) AS scored, count(*) FILTER (score <> 0) AS nonzero, round(min(score), 6) AS least, round(max(score), 6) AS most, round(avg(score), 6) AS mean, max(abs(score)) = 0 AS all_zero FROM sc",
    "iteration_order": "SELECT 'iter_' || (r_regionkey * 7 % 12) AS name, row_number() OVER (ORDER BY r_regionkey * 7 % 12) AS turn FROM region",
    "episode_weighted_loss": f"WITH {F} SELECT round(avg(v / 100 * CASE WHEN ep % 11 = 0 THEN 1 WHEN ep % 3 = 0 THEN 0.25 WHEN ep % 2 = 0 THEN 1 ELSE 0 END), 6) AS loss, count(*) AS rows FROM f",
    "validation_loss": "SELECT round(avg(value), 6) AS loss, count(*) AS rows FROM events",
    "loss_breakdown": f"""WITH {F}, x AS (SELECT j % 9 AS d, v AS e FROM f) SELECT round(avg(e) FILTER (d < 8), 6) AS loss, round(avg(e), 6) AS whole, round(avg(e) FILTER (d < 7), 6) AS real,
        round(avg(e) FILTER (d < 6), 6) AS continuous, round(avg(e) FILTER (d = 6), 6) AS gripper, round(avg(e) FILTER (d >= 7), 6) AS padding FROM x""",
    "chunk_mse_grouping_sets": f"WITH {ERRORS} SELECT h, d::BIGINT AS d, round(avg(e), 4) AS mse FROM e GROUP BY GROUPING SETS ((), (h), (d), (h, d))",
    "chunk_mse_groups": f"WITH {ERRORS} SELECT CASE d WHEN 0 THEN 'first' ELSE 'rest' END AS name, h, round(avg(e), 4) AS mse FROM e GROUP BY 1, 2",
    "best_horizon": f"WITH {ERRORS}, b AS (SELECT d, h, round(avg(e), 4) AS mse FROM e WHERE h > 0 GROUP BY ALL) SELECT d::BIGINT AS d, h AS best, mse FROM b QUALIFY row_number() OVER (PARTITION BY d ORDER BY mse, h) = 1",
    "success_rate_running": f"""WITH {F}, t AS (SELECT task, count(*) AS episodes, count(*) FILTER (v > 50) AS successes FROM f GROUP BY task)
        SELECT task, episodes, successes, round(successes / greatest(1, episodes), 9) AS rate, (sum(episodes) OVER w)::BIGINT AS total_episodes, (sum(successes) OVER w)::BIGINT AS total_successes
        FROM t WINDOW w AS (ORDER BY task ROWS UNBOUNDED PRECEDING)""",
    "episode_status": "SELECT CASE WHEN value > 50 THEN 'success' WHEN event_type = 'error' THEN 'error' ELSE 'failure' END AS status, count(*) AS n FROM events GROUP BY 1",
    "metric_count_windows": 'SELECT ceil(event_id / 50)::BIGINT AS "window", round(avg(value), 6) AS mean, arg_max(value, event_id) AS instant, max(event_id) + 1 AS logged, count(*) AS rows FROM events GROUP BY 1',
    "numeric_means": "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_discount), 6) AS l_discount FROM lineitem",
    "quality_scan": "SELECT count(*) AS checked, count(*) FILTER (event_type = 'error') AS failures, count(DISTINCT user_id) FILTER (event_type = 'error') AS bad_episodes FROM events",
    "quality_scan_first_failure": f"""WITH {F}, m AS (SELECT *, min(j) FILTER (task = 'error') OVER (PARTITION BY ep) AS b FROM f)
        SELECT count(*) AS checked, count(*) FILTER (task = 'error') AS failures, count(DISTINCT ep) FILTER (task = 'error') AS bad_episodes FROM m WHERE b IS NULL OR j <= b""",
    "repair_nearest": f"""WITH {F}, g AS (SELECT *, CASE WHEN task <> 'error' THEN j END AS ok FROM f),
        b AS (SELECT *, max(ok) OVER (PARTITION BY ep ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(ok) OVER (PARTITION BY ep ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM g),
        p AS (SELECT ep, j, CASE WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN j - l <= r - j THEN l ELSE r END AS source FROM b WHERE ok IS NULL)
        SELECT p.ep, p.j, p.source, f.v FROM p LEFT JOIN f ON f.ep = p.ep AND f.j = p.source""",
    "report_episodes": "SELECT DISTINCT user_id AS ep FROM events WHERE event_type = 'error'",
    "influence_one_step": """WITH e AS (SELECT vec_id, vec_id % 50 AS ep, label::DOUBLE AS y, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
        c AS (SELECT vec_id, ep, y, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS d FROM e),
        r AS (SELECT vec_id, any_value(ep) AS ep, 2 * (sum(v * 0.05 * (d % 3)) - any_value(y)) AS r, 2 * (sum(v * 0.05 * (d % 3) * (1 - 2.5e-5 / 401 * 1e-10)) - any_value(y)) AS r1 FROM c GROUP BY vec_id),
        g AS (SELECT d, avg(v * r1) AS g FROM c JOIN r USING (vec_id) WHERE vec_id % 10 = 0 GROUP BY d),
        w AS (SELECT vec_id, sum(v * g) AS w FROM c JOIN g USING (d) WHERE vec_id % 10 <> 0 GROUP BY vec_id)
        SELECT ep, round(-(2.5e-5 / 401) / 1e-4 * sum(r * w) / (SELECT count(*) FROM w), 9) AS score FROM r JOIN w USING (vec_id) GROUP BY ep""",
    "influence_logistic": f"""WITH {LOGISTIC}, g AS (SELECT d, avg(v * s1) AS g FROM c JOIN r USING (vec_id) WHERE vec_id % 10 = 0 GROUP BY d),
        w AS (SELECT vec_id, sum(v * g) AS w FROM c JOIN g USING (d) WHERE vec_id % 10 <> 0 GROUP BY vec_id)
        SELECT ep, round(-(2.5e-5 / 401) / 1e-4 * sum(s * w) / (SELECT count(*) FROM w), 9) AS score FROM r JOIN w USING (vec_id) GROUP BY ep""",
    "curvature_product": f"""WITH {LOGISTIC} SELECT d, round(avg(v * s), 9) AS gradient, round(avg(v * k * along), 9) AS product FROM c JOIN r USING (vec_id) GROUP BY d""",
    "save_points": """WITH n AS (SELECT user_id AS ep, count(*) AS n FROM events GROUP BY 1)
        SELECT ep, i, least(25 * i, n)::BIGINT AS step FROM n, range(1 + (SELECT max((n + 24) // 25) FROM n)) AS t(i) WHERE i <= (n + 24) // 25""",
    "trajectory_layout": f"""WITH {F} SELECT ep, j AS step, CASE WHEN j > greatest(0, n - 8) THEN j - 1 ELSE j END AS batch, n AS total, greatest(0, n - 8) AS before, n - greatest(0, n - 8) - 1 AS after FROM f""",
    "attention_mask": f"""WITH {SHORT}, c AS (SELECT ep, j, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY ep ORDER BY j) AS c FROM g)
        SELECT a.ep, a.j, count(*) AS visible FROM c a JOIN c b ON a.ep = b.ep AND b.c <= a.c GROUP BY 1, 2""",
    "frames_in_listed_order": f"WITH {F} SELECT -ep AS pos, ep, j, event_id FROM f",
    "labelled_frame_subset": "SELECT event_id, user_id AS label FROM events WHERE value > 50",
    "run_labels": "SELECT event_id, 'dim_' || CASE WHEN event_id < 10 THEN '0' ELSE '' END || event_id AS label, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events",
    "norm_stats_frame_limit": f"""WITH {F}, g AS (SELECT *, CASE WHEN ep % 5 = 0 THEN 'target' ELSE 'prior' END AS source FROM f),
        e AS (SELECT DISTINCT source, ep FROM g), s AS (SELECT * FROM e QUALIFY row_number() OVER (ORDER BY md5('42|' || source || '/' || ep), source, ep) <= 10),
        r AS (SELECT g.* FROM g JOIN s USING (source, ep) ORDER BY source, ep, j LIMIT 500)
        SELECT count(*) AS rows, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, min(v) AS lo, max(v) AS hi FROM r""",
    "normalize_masked_tail": f"WITH {STATS} SELECT event_id, round((v - m0) / (s0 + 1e-6), 6) AS z0, round(k, 6) AS z1 FROM f, s",
    "mask_padding": """SELECT vec_id, m AS mask, CASE m WHEN 0 THEN 9 ELSE 4 END AS dim, CASE m WHEN 0 THEN 6 ELSE 4 END AS flagged,
        round(list_sum(list_transform(embedding[1:CASE m WHEN 0 THEN 6 ELSE 4 END], lambda x: x::DOUBLE)), 5) AS kept FROM embeddings, range(2) AS t(m)""",
    "state_assembly_whole_gripper": f"WITH {F} SELECT event_id, 5::BIGINT AS width, v AS g0, k AS g1 FROM f",
    "frame_mixture_labelled": f"""WITH p AS (SELECT event_id, user_id, CASE WHEN user_id % 5 = 0 THEN 1 ELSE 0 END AS source FROM events),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY event_id) - 1 AS row, count(*) OVER (PARTITION BY source) AS c FROM p),
        c AS (SELECT source, count(*) AS c FROM p GROUP BY source),
        d AS (SELECT i, CASE WHEN {uni(42, 'i')} < 0.7 THEN 0 ELSE 1 END AS source, {uni(43, 'i')} AS w FROM range(2000) AS t(i))
        SELECT i, source::BIGINT AS source, event_id, CASE WHEN source = 0 THEN user_id ELSE -1 END::BIGINT AS label
        FROM (SELECT i, source, CAST(floor(w * c) AS BIGINT) AS row FROM d JOIN c USING (source)) JOIN n USING (source, row)""",
    "first_episodes": "SELECT DISTINCT user_id AS ep FROM events ORDER BY 1 LIMIT 10",
    "limited_passes": " UNION ALL ".join(f"""SELECT {t}::BIGINT AS "pass", o_orderkey, i // 16 AS batch, i % 16 AS place FROM
        (SELECT o_orderkey, row_number() OVER (ORDER BY {key(11 + t, 'o_orderkey')}, o_orderkey) - 1 AS i FROM orders) WHERE i // 16 < least(3, (SELECT count(*) // 16 FROM orders))""" for t in (0, 1)),
    "loss_of_batches": "SELECT round(avg(value), 6) AS loss, count(*) AS rows FROM events",
    "split_summary": f"""WITH {F}, {FIRST}, t AS (SELECT task FROM first WHERE ep % 5 = 0 QUALIFY row_number() OVER (PARTITION BY task ORDER BY {key(42, 'ep')}, ep) <= 3)
        SELECT 'source' AS split, task, count(*) AS episodes FROM first WHERE ep % 5 <> 0 GROUP BY task UNION ALL SELECT 'target', task, count(*) FROM t GROUP BY task""",
    "stream_moments": "SELECT event_type, count(*) AS rows, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1",
    "stream_distinct": "SELECT event_id, user_id FROM events",
    "stream_tumbling": "SELECT epoch(date_trunc('day', ts))::BIGINT AS begins, epoch(date_trunc('day', ts))::BIGINT + 86400 AS ends, event_type, count(*) AS rows FROM events GROUP BY ALL",
    "stream_sessions": """WITH o AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, t, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS session FROM o)
        SELECT min(t) AS begins, max(t) + 1800000000 AS ends, user_id, count(*) AS rows FROM s GROUP BY user_id, session""",
    "stream_count_windows": """WITH o AS (SELECT event_type, value, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 50 AS w FROM events)
        SELECT event_type AS key, w AS window, count(*) AS rows, round(avg(value), 6) AS mean FROM o GROUP BY ALL""",
    "norm_stats_with_nulls": f"""WITH {F}, v0 AS (SELECT task, v AS x, 1 AS w FROM f WHERE event_id % 7 <> 0), {histogram('v0', 'w', 'task')}
        SELECT task, count(*) AS rows, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS lo, max(x) AS hi, round(any_value(q01), 6) AS q01, round(any_value(q99), 6) AS q99
        FROM v0 JOIN (SELECT task, arg_min(quantile, p) AS q01, arg_max(quantile, p) AS q99 FROM hq GROUP BY task) USING (task) GROUP BY task""",
    "action_chunks_with_nulls": f"""WITH {F}, g AS (SELECT *, CASE WHEN event_id % 7 <> 0 THEN v END AS w FROM f)
        SELECT a.event_id, {', '.join(f"max(b.w) FILTER (h = {i}) AS c{i}" for i in range(5))} FROM g a, range(5) AS t(h), g b WHERE b.ep = a.ep AND b.j = least(a.j + h, a.n - 1) GROUP BY a.event_id""",
    "shuffled_batches": f"""WITH RECURSIVE n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM events),
        p AS (SELECT event_id, turn, n, a, {feistel("event_id", 11, True)} AS x FROM events, n, range(2) AS t(turn) UNION ALL SELECT event_id, turn, n, a, {feistel("x", 11, True)} FROM p WHERE x >= n)
        SELECT turn AS pass, x // 64 AS batch, x % 64 AS place, event_id FROM p WHERE x < n AND x // 64 < n // 64""",
    "draws_beyond_the_pool": f"""WITH RECURSIVE n AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM events),
        d AS (SELECT i AS draw, i % n AS spot, i // n AS turn, n, a FROM range((SELECT n * 5 // 2 FROM n)) AS t(i), n),
        p AS (SELECT draw, turn, n, a, {feistel("spot", 19, False)} AS x FROM d UNION ALL SELECT draw, turn, n, a, {feistel("x", 19, False)} FROM p WHERE x >= n)
        SELECT draw, x AS i, user_id AS ep FROM p JOIN events ON event_id = x WHERE x < n""",
    "dataset_round_trip": f"""WITH {F}, {DATASET}
        SELECT 'data/chunk-' || lpad((ep // 1000)::VARCHAR, 3, '0') || '/episode_' || lpad(ep::VARCHAR, 6, '0') || '.parquet' AS file, j AS row, event_id, v, ep AS episode_index, j AS frame_index,
               count(*) OVER (ORDER BY ep, j ROWS UNBOUNDED PRECEDING) - 1 AS index, task_index, round(j / 10.0::DOUBLE, 3) AS seconds FROM f LEFT JOIN tn USING (task)""",
    "repair_touched_files": f"""WITH {F}, g AS (SELECT *, CASE WHEN NOT (task = 'error' AND ep % 10 = 0) THEN j END AS ok FROM f),
        b AS (SELECT *, max(ok) OVER (PARTITION BY ep ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, min(ok) OVER (PARTITION BY ep ORDER BY j ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r,
              count(*) OVER (PARTITION BY ep) > count(ok) OVER (PARTITION BY ep) AS rewritten FROM g),
        p AS (SELECT *, CASE WHEN ok IS NOT NULL THEN j WHEN l IS NULL THEN r WHEN r IS NULL THEN l WHEN j - l <= r - j THEN l ELSE r END AS source FROM b)
        SELECT p.event_id, p.ep AS episode_index, p.j AS frame_index, f.v, p.rewritten FROM p LEFT JOIN f ON f.ep = p.ep AND f.j = p.source""",
    "score_vectors": f"WITH {SCORES} SELECT ep, iter, round(score, 6) AS score FROM sc WHERE score <> 0",
    "include_bitmap": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)",
    "file_footers": "SELECT user_id AS ep, count(*) AS rows, 9::BIGINT AS columns, count(*) FILTER (event_type = 'view') AS tasks_missing, 'v' AS action, 1::BIGINT AS missing FROM events GROUP BY 1",
    "frames_by_number": f"WITH {F}, i AS (SELECT *, count(*) OVER (ORDER BY ep, j ROWS UNBOUNDED PRECEDING) - 1 AS i FROM f) SELECT i, event_id, ep AS episode_index, j AS frame_index FROM i WHERE i % 97 = 0",
    "norm_stats_carried": f"""WITH {F}, g AS (SELECT task, v AS x FROM f WHERE event_id % 7 <> 0),
        r AS (SELECT task, count(*) AS rows, avg(x) AS mean, stddev_pop(x) AS std, min(x) AS lo, max(x) AS hi FROM g GROUP BY task),
        e AS (SELECT *, (SELECT min(e) FROM range(-60, 60) AS t(e) WHERE floor(hi / power(2.0::DOUBLE, e)) - floor(lo / power(2.0::DOUBLE, e)) < 4096) AS e FROM r),
        b AS (SELECT task, floor(x / power(2.0::DOUBLE, e)) AS bin, count(*) AS c FROM g JOIN e USING (task) GROUP BY ALL),
        u AS (SELECT *, sum(c) OVER (PARTITION BY task ORDER BY bin ROWS UNBOUNDED PRECEDING) AS upto FROM b)
        SELECT task, p, rows, round(mean, 6) AS mean, round(std, 6) AS std, lo, hi, greatest(lo, min(bin) * power(2.0::DOUBLE, any_value(e))) AS quantile
        FROM u JOIN e USING (task), (VALUES (0.01::DOUBLE), (0.99::DOUBLE)) AS t(p) WHERE upto >= p * rows GROUP BY task, p, rows, mean, std, lo, hi""",
    "stream_metric_log": "SELECT event_id, event_type, value FROM events",
}
