"""DuckDB SQL stating each registered query independently of Spark.

Tables are the driver's views (``orders``, ``lineitem``, ``events``, ...).
Column names and rounding match ``queries.py`` exactly.
"""

from __future__ import annotations

import hashlib

_ORDER_LINES = "lineitem JOIN orders ON l_orderkey = o_orderkey"
_USAGE = f"""SELECT o_custkey AS "user", CAST(o_orderdate AS DATE) AS day, l_partkey AS app, COUNT(*) AS cnt
FROM {_ORDER_LINES} GROUP BY ALL"""

_VALID = """(SELECT 'c' || c_custkey AS u FROM customer WHERE c_acctbal >= 0
 UNION SELECT 's' || s_suppkey FROM supplier WHERE s_acctbal >= 0)"""

_RECORDS = f"""(SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst,
 CAST(l_quantity * 1000 AS BIGINT) AS dur, l_linestatus AS flag FROM {_ORDER_LINES})"""

_VOICE = f"""WITH r AS (SELECT src, dst FROM {_RECORDS} WHERE dur >= 50000
  AND src IN (SELECT u FROM {_VALID}) AND dst IN (SELECT u FROM {_VALID}))
SELECT src, dst FROM r UNION SELECT dst, src FROM r"""

_MUTUAL = f"""WITH r AS (SELECT src, dst, flag FROM {_RECORDS}
  WHERE src IN (SELECT u FROM {_VALID}) AND dst IN (SELECT u FROM {_VALID})),
b AS (SELECT src, dst, flag FROM r UNION ALL SELECT dst, src, flag FROM r)
SELECT src, dst FROM b GROUP BY src, dst HAVING COUNT(DISTINCT flag) = 2"""

_CONTACTS = f"(({_VOICE}) UNION ({_MUTUAL}))"

_COMPONENTS = f"""WITH RECURSIVE e AS MATERIALIZED (SELECT src AS a, dst AS b FROM {_CONTACTS}),
und AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e),
reach(node, r) AS (
  SELECT node, node FROM nodes
  UNION
  SELECT reach.node, und.b FROM reach JOIN und ON reach.r = und.a)
SELECT node, MIN(r) AS component FROM reach GROUP BY node"""

_TOP10 = f"""WITH c AS ({_COMPONENTS}), s AS (SELECT component, COUNT(*) AS size FROM c GROUP BY component)
SELECT component, size, ROW_NUMBER() OVER (ORDER BY size DESC, component) AS rank
FROM s ORDER BY size DESC, component LIMIT 10"""

_LARGEST = f"""WITH c AS ({_COMPONENTS}), s AS (SELECT component, COUNT(*) AS size FROM c GROUP BY component),
top AS (SELECT component FROM s ORDER BY size DESC, component LIMIT 1)
SELECT node, component FROM c WHERE component IN (SELECT component FROM top)"""


_BOUGHT = f"SELECT DISTINCT o_custkey AS u, l_partkey AS a FROM {_ORDER_LINES}"
_ORDER_DAYS = "SELECT DISTINCT o_custkey AS u, CAST(o_orderdate AS DATE) AS a FROM orders"


def _jaccard_topk(pairs: str, k: int, fill: bool) -> str:
    pair_join = "JOIN" if not fill else "LEFT JOIN"
    return f"""WITH p AS ({pairs}),
d AS (SELECT u, COUNT(*) AS n FROM p GROUP BY u),
o AS (SELECT p1.u AS src, p2.u AS dst, COUNT(*) AS ov FROM p p1 JOIN p p2 ON p1.a = p2.a AND p1.u <> p2.u GROUP BY ALL),
s AS (SELECT d1.u AS src, d2.u AS dst,
        CAST(COALESCE(o.ov, 0) AS DOUBLE) / (d1.n + d2.n - COALESCE(o.ov, 0)) AS score
      FROM d d1 JOIN d d2 ON d1.u <> d2.u {pair_join} o ON o.src = d1.u AND o.dst = d2.u),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, ROUND(score, 9) AS score, rank FROM r WHERE rank <= {k}"""


_COSINE = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_cosine_similarity(a.v, b.v) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM s)
SELECT src, dst, ROUND(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _sym(topk: str) -> str:
    return f"WITH t AS ({topk}) SELECT src, dst FROM t UNION SELECT dst, src FROM t"


_EV_USED = "SELECT DISTINCT user_id AS u, event_type || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS a FROM events"
_EV_STATE = """SELECT DISTINCT user_id AS "user", event_type AS app, CAST(ts AS DATE) AS day FROM events"""


def _next_day(days: str, max_gap: int) -> str:
    return f"""(SELECT d1.day, MIN(d2.day) AS next_day FROM ({days}) d1 JOIN ({days}) d2
   ON d2.day > d1.day AND d2.day <= d1.day + {max_gap} GROUP BY d1.day)"""


_RING = """eu AS (SELECT DISTINCT user_id AS u FROM events),
g AS (SELECT a.u AS src, b.u AS dst FROM eu a JOIN eu b ON b.u = a.u + 1 OR b.u = a.u - 1)"""
_EV_KNN = f"g AS ({_sym(_jaccard_topk(_EV_USED, 10, True))})"

_EV_MODEL = f"""s AS ({_EV_STATE}),
a AS (SELECT app FROM s GROUP BY app HAVING COUNT(DISTINCT "user") >= 10),
u AS (SELECT * FROM s WHERE app IN (SELECT app FROM a)),
c AS {_next_day('SELECT DISTINCT day FROM u', 1)},
r AS (SELECT u."user" AS i, u.app AS j, u.day AS t, 1 AS m0, CASE WHEN x."user" IS NULL THEN 0 ELSE 1 END AS m1
      FROM u JOIN c ON u.day = c.day
      LEFT JOIN u x ON x."user" = u."user" AND x.app = u.app AND x.day = c.next_day),
su AS (SELECT DISTINCT i FROM r),
{_RING},
lk AS (SELECT r.i, r.j, r.t, g.dst AS l, CASE WHEN x."user" IS NULL THEN 0 ELSE 1 END AS ml0
       FROM r JOIN g ON g.src = r.i JOIN su ON su.i = g.dst
       LEFT JOIN u x ON x."user" = g.dst AND x.app = r.j AND x.day = r.t)"""


def _uniform(role: str, id_expr: str, c: int, seed: int) -> str:
    return f"(CAST('0x' || substr(md5('{role}#' || {id_expr} || '#{c}#{seed}'), 1, 8) AS BIGINT) / 4294967296.0)"


def _init(role: str, ids: str, d: int = 5, seed: int = 42) -> str:
    raw = ", ".join(f"{_uniform(role, 'id', c, seed)} AS r{c}" for c in range(d))
    nrm = "sqrt(" + " + ".join(f"r{c} * r{c}" for c in range(d)) + ")"
    cols = ", ".join(f"abs(r{c}) / {nrm} AS f{c}" for c in range(d))
    return f"(SELECT id, {cols} FROM (SELECT id, {raw} FROM ({ids})))"


_POS = f"""SELECT DISTINCT o_custkey AS "user", l_partkey AS app FROM {_ORDER_LINES}"""



def _neg(seed: int) -> str:
    return f"""WITH pos AS ({_POS}),
apps AS (SELECT DISTINCT app FROM pos),
perm AS (SELECT app, ROW_NUMBER() OVER (ORDER BY md5('perm#' || app || '#{seed}'), app) - 1 AS pos FROM apps),
nn AS (SELECT COUNT(*) AS n FROM apps),
deg AS (SELECT "user", COUNT(*) AS p FROM pos GROUP BY "user"),
g AS (SELECT deg."user", deg.p, nn.n, unnest(range(0, least(2 * deg.p, nn.n))) AS g FROM deg CROSS JOIN nn),
cand AS (SELECT "user", p, g, (CAST('0x' || substr(md5('offset#' || "user" || '#{seed}'), 1, 8) AS BIGINT) + g) % n AS pos FROM g),
c2 AS (SELECT cand."user", cand.p, cand.g, perm.app FROM cand JOIN perm ON perm.pos = cand.pos
       WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos."user" = cand."user" AND pos.app = perm.app)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "user" ORDER BY g) AS rk FROM c2)
SELECT "user", app FROM r WHERE rk <= p"""


_NEG = _neg(42)

_SAMPLES = f"""SELECT "user", app, 1.0::DOUBLE AS r FROM ({_POS}) UNION ALL SELECT "user", app, 0.0::DOUBLE FROM ({_NEG})"""

_D = 5
_UCOLS = ", ".join(f"U.f{c} AS u{c}" for c in range(_D))
_VCOLS = ", ".join(f"V.f{c} AS v{c}" for c in range(_D))
_DOT = " + ".join(f"U.f{c} * V.f{c}" for c in range(_D))


def _lmf_ctes(U: str = "U", V: str = "V") -> str:
    return f"""smp AS ({_SAMPLES}),
U AS {_init('u', f'SELECT DISTINCT "user" AS id FROM ({_POS})')},
V AS {_init('v', f'SELECT DISTINCT app AS id FROM ({_POS})')},
J AS (SELECT s."user", s.app, s.r, {_UCOLS}, {_VCOLS}, {_DOT} AS p
      FROM smp s JOIN {U} U ON U.id = s."user" JOIN {V} V ON V.id = s.app)"""


def _grad(key: str, other: str) -> str:
    g = ", ".join(f"ROUND(SUM((1.0 / (1.0 + exp(-p)) - r) * {other}{c}), 8) AS g{c}" for c in range(_D))
    return f'SELECT {key} AS id, {g} FROM J GROUP BY {key}'


_LOSS = "ln(1 + exp(-abs(p))) + greatest(p, 0) - r * p"


def _one_step() -> str:
    eta = "0.0001"
    lu = "(0.0001 * sqrt((SELECT COUNT(*) FROM U)))"
    lv = "(0.0001 * sqrt((SELECT COUNT(*) FROM V)))"
    gu = ", ".join(f"SUM((1.0 / (1.0 + exp(-p)) - r) * v{c}) AS g{c}" for c in range(_D))
    u1 = ", ".join(f"U.f{c} - {eta} * (COALESCE(G.g{c}, 0) + {lu} * U.f{c}) AS f{c}" for c in range(_D))
    dot1 = " + ".join(f"U1.f{c} * V.f{c}" for c in range(_D))
    gv = ", ".join(f"SUM((1.0 / (1.0 + exp(-p1)) - r) * u{c}) AS g{c}" for c in range(_D))
    v1 = ", ".join(f"V.f{c} - {eta} * (COALESCE(G.g{c}, 0) + {lv} * V.f{c}) AS f{c}" for c in range(_D))
    u1cols = ", ".join(f"U1.f{c} AS u{c}" for c in range(_D))
    rnd = ", ".join(f"ROUND(f{c}, 8) AS f{c}" for c in range(_D))
    return f"""WITH {_lmf_ctes()},
GU AS (SELECT "user" AS id, {gu} FROM J GROUP BY "user"),
U1 AS (SELECT U.id, {u1} FROM U LEFT JOIN GU G ON G.id = U.id),
J1 AS (SELECT s.app, s.r, {u1cols}, {dot1} AS p1 FROM smp s JOIN U1 ON U1.id = s."user" JOIN V ON V.id = s.app),
GV AS (SELECT app AS id, {gv} FROM J1 GROUP BY app),
V1 AS (SELECT V.id, {v1} FROM V LEFT JOIN GV G ON G.id = V.id)
SELECT 'u' AS role, id, {rnd} FROM U1 UNION ALL SELECT 'v', id, {rnd} FROM V1"""



def _lmf_run(steps: int, restarts: int, seed: int = 42) -> str:
    """CTEs of a whole training run: ``trained`` has the winning restart's user factors at its best step.

    The runs stated here are too short for the early stop, which needs a loss above 1.001 times the best.
    """
    lu, lv = (f"(0.0001 * sqrt((SELECT COUNT(*) FROM {t}0 WHERE rs = 0)))" for t in "UV")
    own = [f'SELECT {k} AS rs, "user", app, 1.0::DOUBLE AS r FROM ({_POS}) UNION ALL SELECT {k}, "user", app, 0.0 FROM ({_neg(seed + k)})' for k in range(restarts)]
    ctes = [f"smp AS MATERIALIZED ({' UNION ALL '.join(own)})"]
    for table, role, key in (("U", "u", '"user"'), ("V", "v", "app")):
        ids = f"SELECT DISTINCT {key} AS id FROM ({_POS})"
        ctes.append(f"{table}0 AS MATERIALIZED (SELECT CAST(rs AS INTEGER) AS rs, i.* FROM range({restarts}) x(rs), {_init(role, ids)} i)")

    def joined(name: str, u: str, v: str) -> str:
        return f"""{name} AS MATERIALIZED (SELECT s.rs, s."user", s.app, s.r, {_UCOLS}, {_VCOLS}, {_DOT} AS p
  FROM smp s JOIN {u} U ON U.rs = s.rs AND U.id = s."user" JOIN {v} V ON V.rs = s.rs AND V.id = s.app)"""

    def stepped(name: str, old: str, joins: str, key: str, other: str, reg: str, eta: float) -> str:
        g = ", ".join(f"SUM((1.0 / (1.0 + exp(-p)) - r) * {other}{c}) AS g{c}" for c in range(_D))
        f = ", ".join(f"O.f{c} - {eta!r}::DOUBLE * (COALESCE(G.g{c}, 0) + {reg} * O.f{c}) AS f{c}" for c in range(_D))
        return f"""{name} AS MATERIALIZED (SELECT O.rs, O.id, {f} FROM {old} O
  LEFT JOIN (SELECT rs, {key} AS id, {g} FROM {joins} GROUP BY ALL) G ON G.rs = O.rs AND G.id = O.id)"""

    eta, losses = 1e-4, []
    for t in range(steps):
        ctes.append(joined(f"J{t}", f"U{t}", f"V{t}"))
        losses.append(f"SELECT rs, {t} AS step, AVG({_LOSS}) AS train, AVG(CASE WHEN r = 1.0 THEN {_LOSS} END) AS observed FROM J{t} GROUP BY rs")
        if t + 1 < steps:
            ctes.append(stepped(f"U{t + 1}", f"U{t}", f"J{t}", '"user"', "v", lu, eta))
            ctes.append(joined(f"K{t}", f"U{t + 1}", f"V{t}"))
            ctes.append(stepped(f"V{t + 1}", f"V{t}", f"K{t}", "app", "u", lv, eta))
        eta /= 1.0001
    every = " UNION ALL ".join(f"SELECT *, {t} AS step FROM U{t}" for t in range(steps))
    ctes += [
        f"losses AS ({' UNION ALL '.join(losses)})",
        "best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rs ORDER BY train, step) AS nth FROM losses) WHERE nth = 1)",
        "winner AS (SELECT rs, step FROM best ORDER BY observed, rs LIMIT 1)",
        f"trained AS MATERIALIZED (SELECT a.* FROM ({every}) a JOIN winner w ON w.rs = a.rs AND w.step = a.step)",
    ]
    return "WITH " + ",\n".join(ctes)


def _lmf_whole(steps: int, restarts: int, seed: int = 42) -> str:
    """``_lmf_run`` of any number of steps, as a recursion: ``run`` has the factors and losses of every step.

    A restart's steps count up to the one whose loss is above 1.001 times the best before.
    """
    own = [f'SELECT {k} AS rs, "user", app, 1.0::DOUBLE AS r FROM ({_POS}) UNION ALL SELECT {k}, "user", app, 0.0 FROM ({_neg(seed + k)})' for k in range(restarts)]
    names = ", ".join(f"f{c}" for c in range(_D))
    none = ", ".join(f"NULL::DOUBLE AS f{c}" for c in range(_D))

    def first(side: str, key: str) -> str:
        ids = f"SELECT DISTINCT {key} AS id FROM ({_POS})"
        return f"""SELECT 0 AS step, 1e-4::DOUBLE AS eta, CAST(rs AS INTEGER) AS rs, '{side}' AS side, i.*, NULL::DOUBLE AS train, NULL::DOUBLE AS observed
  FROM range({restarts}) x(rs), {_init(side, ids)} i"""

    def joined(u: str) -> str:
        return f"""SELECT s.rs, s."user", s.app, s.r, {_UCOLS}, {_VCOLS}, {_DOT} AS p
  FROM smp s JOIN {u} U ON U.rs = s.rs AND U.id = s."user" JOIN V ON V.rs = s.rs AND V.id = s.app"""

    def stepped(old: str, joins: str, key: str, other: str, reg: str) -> str:
        g = ", ".join(f"SUM((1.0 / (1.0 + exp(-p)) - r) * {other}{c}) AS g{c}" for c in range(_D))
        f = ", ".join(f"O.f{c} - O.eta * (COALESCE(G.g{c}, 0) + (SELECT {reg} FROM reg) * O.f{c}) AS f{c}" for c in range(_D))
        return f"""SELECT O.step, O.eta, O.rs, O.id, {f} FROM {old} O
  LEFT JOIN (SELECT rs, {key} AS id, {g} FROM {joins} GROUP BY ALL) G ON G.rs = O.rs AND G.id = O.id"""

    return f"""WITH RECURSIVE smp AS MATERIALIZED ({' UNION ALL '.join(own)}),
reg AS MATERIALIZED (SELECT 0.0001 * sqrt(COUNT(DISTINCT "user")) AS lu, 0.0001 * sqrt(COUNT(DISTINCT app)) AS lv FROM smp),
run(step, eta, rs, side, id, {names}, train, observed) AS ({first('u', '"user"')} UNION ALL {first('v', 'app')}
UNION ALL (WITH U AS MATERIALIZED (SELECT * FROM run WHERE side = 'u'), V AS MATERIALIZED (SELECT * FROM run WHERE side = 'v'),
J AS MATERIALIZED ({joined('U')}),
U1 AS MATERIALIZED ({stepped('U', 'J', '"user"', 'v', 'lu')}),
K AS MATERIALIZED ({joined('U1')}),
V1 AS ({stepped('V', 'K', 'app', 'u', 'lv')})
SELECT step + 1, eta / 1.0001, rs, 'u', id, {names}, NULL, NULL FROM U1 WHERE step + 1 < {steps}
UNION ALL SELECT step + 1, eta / 1.0001, rs, 'v', id, {names}, NULL, NULL FROM V1 WHERE step + 1 < {steps}
UNION ALL SELECT (SELECT MAX(step) FROM U), NULL, rs, 'l', NULL, {none}, AVG({_LOSS}), AVG(CASE WHEN r = 1.0 THEN {_LOSS} END) FROM J GROUP BY rs)),
losses AS (SELECT rs, step, train, observed FROM run WHERE side = 'l'),
upto AS (SELECT *, MIN(train) OVER (PARTITION BY rs ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM losses),
stops AS (SELECT rs, MIN(step) AS stop FROM upto WHERE train > 1.001 * least GROUP BY rs),
counted AS (SELECT l.* FROM losses l LEFT JOIN stops s ON s.rs = l.rs WHERE s.stop IS NULL OR l.step < s.stop),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY rs ORDER BY train, step) AS nth FROM counted) WHERE nth = 1),
winner AS (SELECT rs, step FROM best ORDER BY observed, rs LIMIT 1),
trained AS MATERIALIZED (SELECT a.* FROM run a JOIN winner w ON w.rs = a.rs AND w.step = a.step WHERE a.side = 'u')"""


def _trained_users(steps: int, restarts: int) -> str:
    return f"{_lmf_whole(steps, restarts)}\nSELECT id, {', '.join(f'ROUND(f{c}, 8) AS f{c}' for c in range(_D))} FROM trained"


def _trained_graph(steps: int, restarts: int, k: int = 10) -> str:
    """The symmetrised k-NN graph of the trained users by cosine."""
    dot = " + ".join(f"a.f{c} * b.f{c}" for c in range(_D))
    size = lambda t: "sqrt(" + " + ".join(f"{t}.f{c} * {t}.f{c}" for c in range(_D)) + ")"
    return f"""{_lmf_run(steps, restarts)},
scored AS (SELECT a.id AS src, b.id AS dst, ({dot}) / ({size('a')} * {size('b')}) AS score FROM trained a JOIN trained b ON a.id <> b.id),
near AS (SELECT src, dst FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY src ORDER BY score DESC, dst) AS nth FROM scored) WHERE nth <= {k})
SELECT src, dst FROM near UNION SELECT dst, src FROM near"""


def _coordinates(d: int, seed: int, fold: int, epochs: int) -> list[int]:
    """The epochs' coordinates: an md5 of seed, fold and epoch picks among those that the epoch before did not."""
    out: list[int] = []
    for epoch in range(epochs):
        left = [c for c in range(d) if d == 1 or c not in out[-1:]]
        out.append(left[int(hashlib.md5(f"{seed}#{fold}#{epoch}".encode()).hexdigest()[:8], 16) % len(left)])
    return out


def _cross_validation(ranks: tuple[int, ...], folds: int, epochs: int, seed: int = 42) -> str:
    """CTEs of repeated day hold-out on the ring graph: ``scores`` has (rank, fold, epoch, v), v the validation RMSE."""
    ctes = [
        _EV_MODEL,
        """deg AS (SELECT i, j, t, COUNT(*) AS n FROM lk GROUP BY ALL)""",
        """terms AS MATERIALIZED (SELECT i, j, t, i AS "user", CAST(m0 AS DOUBLE) AS w FROM r
  UNION ALL SELECT lk.i, lk.j, lk.t, lk.l, CAST(lk.ml0 AS DOUBLE) / greatest(deg.n, 1)
  FROM lk JOIN deg ON deg.i = lk.i AND deg.j = lk.j AND deg.t = lk.t WHERE lk.ml0 <> 0)""",
        f"""days AS (SELECT fold, t, ROW_NUMBER() OVER (PARTITION BY fold ORDER BY md5(CAST(t AS VARCHAR) || '#' || fold || '#{seed}'), t)
    <= floor(COUNT(*) OVER (PARTITION BY fold) * 0.8) AS is_train
  FROM (SELECT DISTINCT t FROM r), (SELECT CAST(unnest(range(0, {folds})) AS INTEGER) AS fold))""",
    ]
    scores = []
    for d in ranks:
        lu = "(0.0001 * sqrt((SELECT COUNT(DISTINCT i) FROM r)))"
        lv = "(0.0001 * sqrt((SELECT COUNT(DISTINCT j) FROM r)))"
        sums = ", ".join(f"SUM(w * F.f{c}) AS x{c}" for c in range(d))
        kept = ", ".join([f"x{c}" for c in range(d)] + [f"F.f{c} AS v{c}" for c in range(d)])
        dot = " + ".join(f"x{c} * F.f{c}" for c in range(d))
        for fold, coordinates in ((f, _coordinates(d, seed, f, epochs)) for f in range(folds)):
            m = f"{d}_{fold}_"

            def predicted(name: str, u: str, v: str) -> str:
                return f"""{name} AS MATERIALIZED (SELECT X.i, X.j, X.t, D.is_train, {kept}, ({dot}) - r.m1 AS e
  FROM (SELECT terms.i, terms.j, terms.t, {sums} FROM terms JOIN {u} F ON F.id = terms."user" GROUP BY ALL) X
  JOIN r ON r.i = X.i AND r.j = X.j AND r.t = X.t JOIN {v} F ON F.id = X.j JOIN days D ON D.t = X.t AND D.fold = {fold})"""

            def newton(name: str, old: str, stats: str, c: int, lam: str) -> str:
                rule = f"CASE WHEN S.B IS NOT NULL AND S.B <> 0 AND S.A > 0 THEN O.f{c} - (S.B + {lam} * sign(O.f{c})) / S.A ELSE O.f{c} END AS f{c}"
                columns = ", ".join(rule if k == c else f"O.f{k}" for k in range(d))
                return f"{name} AS MATERIALIZED (SELECT O.id, {columns} FROM {old} O LEFT JOIN ({stats}) S ON S.id = O.id)"

            ctes.append(f"U{m}0 AS MATERIALIZED {_init('eu', 'SELECT DISTINCT i AS id FROM r', d, seed)}")
            ctes.append(f"V{m}0 AS MATERIALIZED {_init('ev', 'SELECT DISTINCT j AS id FROM r', d, seed)}")
            for e, c in enumerate(coordinates):
                ctes.append(predicted(f"P{m}{e}", f"U{m}{e}", f"V{m}{e}"))
                scores.append(f"SELECT {d} AS rank, {fold} AS fold, {e} AS epoch, sqrt(AVG(e * e)) AS v FROM P{m}{e} WHERE NOT is_train")
                if e + 1 < epochs:
                    of_users = f"""SELECT terms."user" AS id, SUM(w * v{c} * w * v{c}) AS A, SUM(w * v{c} * e) AS B FROM terms
      JOIN P{m}{e} P ON P.i = terms.i AND P.j = terms.j AND P.t = terms.t WHERE is_train GROUP BY terms."user\""""
                    ctes.append(newton(f"U{m}{e + 1}", f"U{m}{e}", of_users, c, lu))
                    ctes.append(predicted(f"Q{m}{e}", f"U{m}{e + 1}", f"V{m}{e}"))
                    of_apps = f"SELECT j AS id, SUM(x{c} * x{c}) AS A, SUM(x{c} * e) AS B FROM Q{m}{e} WHERE is_train GROUP BY j"
                    ctes.append(newton(f"V{m}{e + 1}", f"V{m}{e}", of_apps, c, lv))
    ctes.append(f"scores AS ({' UNION ALL '.join(scores)})")
    # an epoch counts unless one before it reached 1.01 times the best so far without bettering it
    ctes.append("""upto AS (SELECT *, MIN(v) OVER (PARTITION BY rank, fold ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM scores),
stops AS (SELECT rank, fold, MIN(epoch) AS stop FROM upto WHERE v >= best AND v >= 1.01 * best GROUP BY ALL),
counted AS (SELECT u.rank, u.fold, u.epoch, u.v FROM upto u LEFT JOIN stops s ON s.rank = u.rank AND s.fold = u.fold
  WHERE s.stop IS NULL OR u.epoch <= s.stop)""")
    return "WITH " + ",\n".join(ctes)


_MD = 7


def _model_ctes() -> str:
    xs = ", ".join(f"SUM(w * FU.f{c}) AS x{c}" for c in range(_MD))
    return f"""WITH {_EV_MODEL},
deg AS (SELECT i, j, t, COUNT(*) AS n FROM lk GROUP BY ALL),
terms AS (SELECT i, j, t, i AS "user", CAST(m0 AS DOUBLE) AS w FROM r
  UNION ALL SELECT lk.i, lk.j, lk.t, lk.l, CAST(lk.ml0 AS DOUBLE) / greatest(deg.n, 1)
  FROM lk JOIN deg ON deg.i = lk.i AND deg.j = lk.j AND deg.t = lk.t WHERE lk.ml0 <> 0),
FU AS {_init('eu', 'SELECT DISTINCT i AS id FROM r', _MD)},
FV AS {_init('ev', 'SELECT DISTINCT j AS id FROM r', _MD)},
X AS (SELECT terms.i, terms.j, terms.t, {xs} FROM terms JOIN FU ON FU.id = terms."user" GROUP BY ALL),
{_pred('P', 'X')}"""


def _pred(name: str, xname: str) -> str:
    vs = ", ".join(f"FV.f{c} AS v{c}" for c in range(_MD))
    xs = ", ".join(f"{xname}.x{c}" for c in range(_MD))
    dot = " + ".join(f"{xname}.x{c} * FV.f{c}" for c in range(_MD))
    return f"""{name} AS (SELECT r.i, r.j, r.t, r.m1, {xs}, {vs}, ({dot}) AS p, ({dot}) - r.m1 AS e
  FROM r JOIN {xname} ON {xname}.i = r.i AND {xname}.j = r.j AND {xname}.t = r.t JOIN FV ON FV.id = r.j)"""


def _upd(tbl: str, stats: str, c: int, lam: str, rule: str) -> str:
    cols = ", ".join((f"{rule} AS f{k}" if k == c else f"{tbl}.f{k}") for k in range(_MD))
    return f"SELECT {tbl}.id, {cols} FROM {tbl} LEFT JOIN {stats} S ON S.id = {tbl}.id"


_LU = "(0.0001 * sqrt((SELECT COUNT(*) FROM FU)))"
_LV = "(0.0001 * sqrt((SELECT COUNT(*) FROM FV)))"
_NEWTON_U = f"""S_U AS (SELECT terms."user" AS id, SUM((w * P.v0) * (w * P.v0)) AS A, SUM((w * P.v0) * P.e) AS B
  FROM terms JOIN P ON P.i = terms.i AND P.j = terms.j AND P.t = terms.t GROUP BY terms."user"),
FU1 AS ({_upd('FU', 'S_U', 0, _LU, f"CASE WHEN S.B IS NOT NULL AND S.B <> 0 AND S.A > 0 THEN FU.f0 - (S.B + {_LU} * sign(FU.f0)) / S.A ELSE FU.f0 END")})"""


def _round_cols(tbl: str) -> str:
    return "SELECT id, " + ", ".join(f"ROUND(f{c}, 8) AS f{c}" for c in range(_MD)) + f" FROM {tbl}"


def _newton_item() -> str:
    xs = ", ".join(f"SUM(w * FU1.f{c}) AS x{c}" for c in range(_MD))
    return f"""{_model_ctes()},
{_NEWTON_U},
X1 AS (SELECT terms.i, terms.j, terms.t, {xs} FROM terms JOIN FU1 ON FU1.id = terms."user" GROUP BY ALL),
{_pred('P1', 'X1')},
S_V AS (SELECT j AS id, SUM(x0 * x0) AS A, SUM(x0 * e) AS B FROM P1 GROUP BY j),
FV1 AS ({_upd('FV', 'S_V', 0, _LV, f"CASE WHEN S.B IS NOT NULL AND S.B <> 0 AND S.A > 0 THEN FV.f0 - (S.B + {_LV} * sign(FV.f0)) / S.A ELSE FV.f0 END")})
{_round_cols('FV1')}"""


def _gd_user() -> str:
    n = "(SELECT COUNT(*) FROM r)"
    return f"""{_model_ctes()},
GRAD AS (SELECT terms."user" AS id, SUM(P.e * w * P.v0) AS g FROM terms JOIN P ON P.i = terms.i AND P.j = terms.j AND P.t = terms.t GROUP BY terms."user"),
FU1 AS ({_upd('FU', 'GRAD', 0, _LU, f"CASE WHEN S.g IS NOT NULL THEN FU.f0 - 0.5 * (S.g / {n} + {_LU} * sign(FU.f0)) ELSE FU.f0 END")})
{_round_cols('FU1')}"""


def _gd_item() -> str:
    n = "(SELECT COUNT(*) FROM r)"
    return f"""{_model_ctes()},
GRAD AS (SELECT j AS id, SUM(e * x0) AS g FROM P GROUP BY j),
FV1 AS ({_upd('FV', 'GRAD', 0, _LV, f"CASE WHEN S.g IS NOT NULL THEN FV.f0 - 0.5 * (S.g / {n} + {_LV} * sign(FV.f0)) ELSE FV.f0 END")})
{_round_cols('FV1')}"""


def _holdout(folds: int) -> str:
    return f"""WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events),
f AS (SELECT CAST(unnest(range(0, {folds})) AS INTEGER) AS fold),
x AS (SELECT fold, day,
  ROW_NUMBER() OVER (PARTITION BY fold ORDER BY md5(CAST(day AS VARCHAR) || '#' || fold || '#' || 42), day) AS rk,
  COUNT(*) OVER (PARTITION BY fold) AS n FROM d CROSS JOIN f)
SELECT fold, day, rk <= floor(n * 0.8) AS is_train FROM x"""


SQL: dict[str, str] = {
    "usage_daily": _USAGE,
    "usage_text_parse": f"""SELECT CAST(o_custkey AS VARCHAR) AS "user", CAST(o_orderdate AS DATE) AS day,
  CASE WHEN p_size <= 25 THEN CAST(l_partkey AS VARCHAR) ELSE 'u' || l_partkey END AS app, COUNT(*) AS cnt
FROM {_ORDER_LINES} JOIN part ON p_partkey = l_partkey
WHERE p_size <= 45 AND CAST(o_orderdate AS DATE) < DATE '1998-01-01'
GROUP BY ALL""",
    "usage_union_sum": f"""SELECT "user", day, app, CAST(SUM(cnt) AS BIGINT) AS cnt FROM (
  SELECT o_custkey AS "user", CAST(o_orderdate AS DATE) AS day, l_partkey AS app, COUNT(*) AS cnt
  FROM {_ORDER_LINES} WHERE l_linestatus = 'O' GROUP BY ALL
  UNION ALL
  SELECT o_custkey, CAST(o_orderdate AS DATE), l_partkey, COUNT(*)
  FROM {_ORDER_LINES} WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY ALL""",
    "host_app_match": """WITH l AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, url FROM pages),
h AS (SELECT DISTINCT host, 'app:' || host AS app FROM l WHERE host LIKE '%.example.com'),
u AS (SELECT url, 'page:' || page_id AS app FROM l WHERE host LIKE '%.example.net')
SELECT l.page_id, l.host, COALESCE(h.app, u.app) AS app
FROM l LEFT JOIN h ON l.host = h.host LEFT JOIN u ON l.url = u.url
WHERE COALESCE(h.app, u.app) IS NOT NULL""",
    "usage_stats": f"""WITH u AS ({_USAGE}), p AS (SELECT DISTINCT "user", app FROM u)
SELECT (SELECT COUNT(*) FROM u) AS n_rows, (SELECT COUNT(*) FROM p) AS n_pairs,
  (SELECT COUNT(DISTINCT "user") FROM u) AS n_users, (SELECT COUNT(DISTINCT app) FROM u) AS n_apps,
  ROUND((SELECT COUNT(*) FROM p) / (SELECT COUNT(DISTINCT "user") FROM u), 6) AS mean_apps_per_user""",
    "usage_date_bound": f"SELECT * FROM ({_USAGE}) WHERE day < DATE '1998-01-01'",
    "day_split": f"""SELECT *, CASE WHEN day <= DATE '1997-06-30' THEN 'train' ELSE 'test' END AS part
FROM ({_USAGE}) WHERE day <= DATE '1997-06-30' OR day >= DATE '1997-08-01'""",
    "popular_apps": f"""SELECT app, COUNT(DISTINCT "user") AS n_users FROM ({_USAGE}) GROUP BY app
HAVING COUNT(DISTINCT "user") >= 30""",
    "involved_users": f"""WITH u AS (SELECT * FROM ({_USAGE}) WHERE "user" IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)),
a AS (SELECT app FROM u GROUP BY app HAVING COUNT(DISTINCT "user") >= 30)
SELECT "user", COUNT(DISTINCT app) AS n_apps FROM u WHERE app IN (SELECT app FROM a) GROUP BY "user\"""",
    "user_app_sets": f"""WITH p AS (SELECT DISTINCT "user", app FROM ({_USAGE}))
SELECT "user", string_agg(CAST(app AS VARCHAR), ',' ORDER BY app) AS apps, COUNT(*) AS n_apps FROM p GROUP BY "user\"""",
    "app_sets_text": f"""WITH p AS (SELECT DISTINCT "user", app FROM ({_USAGE}))
SELECT "user" || '|' || string_agg(CAST(app AS VARCHAR), ',' ORDER BY app) AS value FROM p GROUP BY "user\"""",
    "app_sets_decoded": f"""SELECT DISTINCT "user", app FROM ({_USAGE})""",
    "voice_text_parse": f"""SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, CAST(o_orderdate AS DATE) AS day,
  COUNT(*) AS calls, CAST(SUM(CAST(l_quantity * 1000 AS BIGINT)) AS BIGINT) AS dur FROM {_ORDER_LINES} GROUP BY ALL""",
    "sms_text_parse": f"""SELECT src, dst, CAST(CASE WHEN flag = 'O' THEN 1 ELSE 0 END AS BIGINT) AS flag, COUNT(*) AS messages
FROM {_RECORDS} GROUP BY ALL""",
    "voice_contacts": _VOICE,
    "mutual_contacts": _MUTUAL,
    "contact_graph": f"({_VOICE}) UNION ({_MUTUAL})",
    "components": _COMPONENTS,
    "component_sizes_top10": _TOP10,
    "largest_component": _LARGEST,
    "induced_subgraph": f"""WITH l AS ({_LARGEST}),
m AS {_CONTACTS}
SELECT src, dst FROM m WHERE src IN (SELECT node FROM l) AND dst IN (SELECT node FROM l)""",
    "node_index": f"""SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM ({_LARGEST})""",
    "node_index_text": f"""SELECT node || ',' || (ROW_NUMBER() OVER (ORDER BY node) - 1) AS value FROM ({_LARGEST})""",
    "node_index_decoded": f"""SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM ({_LARGEST})""",
    "recoded_subgraph": f"""WITH l AS ({_LARGEST}),
ix AS (SELECT node, ROW_NUMBER() OVER (ORDER BY node) - 1 AS idx FROM l),
m AS {_CONTACTS}
SELECT s.idx AS src, d.idx AS dst FROM m JOIN ix s ON s.node = m.src JOIN ix d ON d.node = m.dst""",
    "direct_knn_topk": _jaccard_topk(_BOUGHT, 10, True),
    "direct_knn_graph": _sym(_jaccard_topk(_BOUGHT, 10, True)),
    "direct_knn_filled": _jaccard_topk(_ORDER_DAYS, 10, True),
    "direct_knn_positive": _jaccard_topk(_ORDER_DAYS, 10, False),
    "cosine_knn_topk": _COSINE,
    "cosine_knn_graph": _sym(_COSINE),
    "combined_graph": f"""({_VOICE}) UNION ({_MUTUAL}) UNION
SELECT 'c' || src, 'c' || dst FROM ({_sym(_jaccard_topk(_BOUGHT, 10, True))})""",
    "calendar_next_day": f"""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
n AS (SELECT day, LEAD(day) OVER (ORDER BY day) AS nx FROM d)
SELECT day, CASE WHEN datediff('day', day, nx) <= 2 THEN nx END AS next_day FROM n""",
    "retention_labels": f"""WITH s AS ({_EV_STATE}), c AS {_next_day('SELECT DISTINCT day FROM s', 1)}
SELECT s."user", s.app, s.day, c.next_day, CASE WHEN x."user" IS NULL THEN 0 ELSE 1 END AS m1
FROM s JOIN c ON s.day = c.day LEFT JOIN s x ON x."user" = s."user" AND x.app = s.app AND x.day = c.next_day""",
    "exposure_rows": f"""WITH {_EV_MODEL}
SELECT r.i, r.j, r.t, r.m0, r.m1, COUNT(lk.l) AS n_nbrs, CAST(COALESCE(SUM(lk.ml0), 0) AS BIGINT) AS sum_ml0
FROM r LEFT JOIN lk ON lk.i = r.i AND lk.j = r.j AND lk.t = r.t GROUP BY ALL""",
    "exposure_text": f"""WITH {_EV_MODEL}
SELECT r.i || ',' || r.j || ',' || strftime(r.t, '%Y%m%d') || ',' || r.m0 || ',' || r.m1 || ','
  || COALESCE(string_agg(lk.l || '#' || lk.ml0, '|' ORDER BY lk.l, lk.ml0), '') AS value
FROM r LEFT JOIN lk ON lk.i = r.i AND lk.j = r.j AND lk.t = r.t GROUP BY r.i, r.j, r.t, r.m0, r.m1""",
    "holdout_days": _holdout(3),
    "holdout_days_full": _holdout(10),
    "negative_samples": _NEG,
    "train_samples": _SAMPLES,
    "factor_init": "SELECT id, " + ", ".join(f"ROUND(f{c}, 9) AS f{c}" for c in range(_D))
    + " FROM " + _init("u", f'SELECT DISTINCT "user" AS id FROM ({_POS})'),
    "vector_ops": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS nrm FROM e)
SELECT vec_id, ROUND(nrm, 6) AS norm,
  ROUND(list_sum(list_transform(v, lambda x: x * x)), 6) AS self_dot,
  ROUND(list_sum(list_transform(v, lambda x: abs(x) / nrm)), 6) AS unit_sum,
  ROUND(v[1], 6) AS first,
  ROUND(list_sum(list_transform(v, lambda x: 2.0 * x + 3.0 * (abs(x) / nrm))), 6) AS weighted_sum,
  ROUND(list_sum(list_transform(v, lambda x: x + (x * 3.0 - x))), 6) AS add_sum
FROM n""",
    "logloss_at_init": f"""WITH {_lmf_ctes()}
SELECT ROUND(AVG({_LOSS}), 8) AS train_loss, ROUND(AVG(CASE WHEN r = 1.0 THEN {_LOSS} END), 8) AS observed_loss FROM J""",
    "lmf_grad_user": f"WITH {_lmf_ctes()} " + _grad('"user"', "v"),
    "lmf_grad_item": f"WITH {_lmf_ctes()} " + _grad("app", "u"),
    "lmf_one_step": _one_step(),
    "exposure_predict_rmse": f"{_model_ctes()} SELECT ROUND(sqrt(AVG(e * e)), 8) AS rmse FROM P",
    "newton_user_step": f"{_model_ctes()}, {_NEWTON_U} {_round_cols('FU1')}",
    "newton_item_step": _newton_item(),
    "gd_user_step": _gd_user(),
    "gd_item_step": _gd_item(),
}
SQL["exposure_decoded"] = SQL["exposure_rows"]
SQL["factors_decoded"] = SQL["factor_init"]
SQL["lmf_train"] = _trained_users(800, 6)
SQL["improved_knn_graph"] = _trained_graph(4, 2)
SQL["exposure_model_cv"] = f"{_cross_validation((7,), 10, 21)} SELECT CAST(fold AS INTEGER) AS fold, ROUND(MIN(v), 8) AS best_rmse FROM counted GROUP BY fold"
SQL["sweep"] = f"""{_cross_validation((1, 2), 1, 2)}, b AS (SELECT rank, fold, MIN(v) AS v FROM counted GROUP BY ALL)
SELECT CAST(rank AS INTEGER) AS rank, ROUND(MIN(v), 8) AS min_rmse, ROUND(AVG(v), 8) AS mean_rmse FROM b GROUP BY rank"""
SQL |= {
    f"{name}_knn": SQL[name].replace(_RING, _EV_KNN)
    for name in SQL
    if name.startswith("exposure_") and name != "exposure_model_cv" or name.endswith(("_user_step", "_item_step"))
}
SQL |= {
    "usage_files": SQL["usage_text_parse"],
    "log_files": f"""SELECT CASE l_linestatus WHEN 'O' THEN 'other' ELSE 'web' END AS log,
  CAST(CASE l_linestatus WHEN 'O' THEN 64 ELSE 4 END AS BIGINT) AS n_files, COUNT(*) AS n_lines
FROM {_ORDER_LINES} WHERE l_linestatus IN ('O', 'F') GROUP BY l_linestatus""",
    "built_once": f"""SELECT "user", COUNT(*) AS n_rows, CAST(SUM(cnt) AS BIGINT) AS n_lines FROM ({_USAGE}) GROUP BY "user\"""",
    "contact_files": SQL["contact_graph"],
    "edge_files": SQL["induced_subgraph"],
}


def _spread_labels(sec: int) -> str:
    """Components by 30 rounds of least labels, more than the graphs' diameters."""
    voice = _VOICE.replace("dur >= 50000", f"dur >= {sec * 1000}")
    return f"""SELECT CAST({sec} AS BIGINT) AS min_sec, node, component FROM (
WITH RECURSIVE e AS MATERIALIZED (({voice}) UNION ({_MUTUAL})),
und AS MATERIALIZED (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e),
labels(round, node, label) AS (
  SELECT 0, a, a FROM (SELECT DISTINCT a FROM und)
  UNION ALL
  SELECT round + 1, b, MIN(label) FROM labels JOIN und ON a = node WHERE round < 30 GROUP BY round, b)
SELECT node, label AS component FROM labels WHERE round = 30)"""


SQL["components_by_duration"] = " UNION ALL ".join(f"({_spread_labels(sec)})" for sec in (15, 20, 25, 30))


def _part(name: str, days: str) -> str:
    model = _EV_MODEL.replace("FROM u JOIN c ON u.day = c.day", f"FROM u JOIN c ON u.day = c.day AND {days}")
    return SQL["exposure_rows"].replace(_EV_MODEL, model).replace("SELECT r.i, r.j", f"SELECT '{name}' AS part, r.i, r.j")


SQL["exposure_parts"] = f"({_part('train', 'u.day <= DATE \'2024-01-20\'')}) UNION ALL ({_part('test', 'u.day >= DATE \'2024-01-24\'')})"
