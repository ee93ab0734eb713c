"""DuckDB forms of the recording, shared by the oracles."""

REC = """
    n AS (SELECT count(*) AS n FROM embeddings),
    tr AS (SELECT event_id AS spike_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) * 979 // 43200000 AS sample,
        CAST((user_id * 7 + event_id) % 64 AS INT) AS channel, user_id, event_type AS kind, value AS amp FROM events),
    train AS (SELECT *, sample / 30000.0::DOUBLE AS t FROM tr),
    sp AS (SELECT t.*, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (amp / 10)) AS w
        FROM train t, n JOIN embeddings e ON true WHERE e.vec_id = t.spike_id % n.n),
    z AS (SELECT *, list_transform(range(64), lambda i: w[i + 1] - list_sum(w[(i // 8) * 8 + 1 : (i // 8) * 8 + 8]) / 8) AS zw,
        list_transform(range(8), lambda c: list_max(w[c * 8 + 1 : c * 8 + 8]) - list_min(w[c * 8 + 1 : c * 8 + 8])) AS ptp FROM sp)"""
GEO = """
    ch AS (SELECT CAST(i AS INT) AS channel, CAST((i % 4) * 20 + ((i // 4) % 2) * 10 AS DOUBLE) AS x, CAST((i // 4) * 20 AS DOUBLE) AS y FROM range(64) r(i)),
    nb AS (SELECT a.channel, row_number() OVER (PARTITION BY a.channel ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.channel) - 1 AS slot,
        b.channel AS nbr, b.x - a.x AS dx, b.y - a.y AS dy FROM ch a, ch b QUALIFY slot < 8),
    ga AS (SELECT channel, list(dx ORDER BY slot) AS dx, list(dy ORDER BY slot) AS dy FROM nb GROUP BY channel),
    geo AS (SELECT ga.*, x, y, CAST(dense_rank() OVER (ORDER BY dx, dy) - 1 AS BIGINT) AS cfg FROM ga JOIN ch USING (channel))"""
LAT = """
    cand AS (SELECT row_number() OVER (ORDER BY px, py, pz) - 1 AS n, px, py, pz
        FROM (VALUES (-20.0::DOUBLE), (0.0), (20.0)) a(px), (VALUES (-20.0::DOUBLE), (0.0), (20.0)) b(py), (VALUES (5.0::DOUBLE), (20.0), (60.0)) c(pz)),
    fp0 AS (SELECT channel, cfg, x, y, n, px, py, pz, list_transform(range(1, 9), lambda i: 15.0 / sqrt((dx[i] - px) ** 2 + (dy[i] - py) ** 2 + pz * pz + 225.0)) AS g FROM geo, cand),
    fp AS (SELECT * EXCLUDE g, list_transform(g, lambda v: v / sqrt(list_sum(list_transform(g, lambda q: q * q)))) AS g FROM fp0),
    om AS (SELECT m, list_transform(range(8), lambda i: 0.5 * cos(pi() * (2 * i + 1) * m / 16)) AS o FROM range(1, 5) r(m)),
    pj AS (SELECT spike_id, channel, t, amp, kind, list_sum(list_transform(zw, lambda v: v * v)) AS energy, m,
        list_transform(range(8), lambda c: list_sum(list_transform(range(1, 9), lambda i: zw[c * 8 + i] * o[i]))) AS p FROM z, om),
    sc AS (SELECT spike_id, n, sum(list_sum(list_transform(range(1, 9), lambda c: g[c] * p[c])) ** 2) AS score,
        any_value(t) AS t, any_value(amp) AS amp, any_value(kind) AS kind, any_value(energy) AS energy, any_value(pj.channel) AS channel,
        any_value(x + px) AS px, any_value(y + py) AS py, any_value(pz) AS pz FROM pj JOIN fp ON pj.channel = fp.channel GROUP BY spike_id, n),
    loc AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY spike_id ORDER BY round(score, 9) DESC, n) = 1)"""
WAY = """
    seg(t0, p0, t1, p1) AS (VALUES (0.0::DOUBLE, 0.0::DOUBLE, 400.0::DOUBLE, 50.0::DOUBLE), (400.0, 50.0, 800.0, 0.0), (800.0, 0.0, 1200.0, 50.0), (1200.0, 50.0, 1600.0, 0.0), (1600.0, 0.0, 1958.0, 44.75))"""
