"""Building blocks of the check SQL: the views as CTEs and a generated regression."""

from __future__ import annotations

from paceline.catalog.views import PRIORITIES
from paceline.schemas import FAMILIES, FEATURES

K = len(FEATURES)
DIM = K + 1

PROP = """prop AS (
  SELECT cast(o_orderdate AS date) AS date, o_orderstatus AS product,
         substr(sha256(cast(o_orderkey AS varchar)), 1, 16) AS config_hash,
         o_orderpriority AS family, o_orderkey, o_totalprice,
         CASE WHEN substr(sha256(cast(o_orderkey AS varchar)), 1, 1) <= '3' THEN 'best'
              WHEN substr(sha256(cast(o_orderkey AS varchar)), 1, 1) <= '9' THEN 'alt'
              WHEN substr(sha256(cast(o_orderkey AS varchar)), 1, 1) <= 'b' THEN 'explore'
              ELSE 'candidate' END AS proposal_type
  FROM orders)"""

LINES = """lines AS (
  SELECT l_orderkey AS o_orderkey, count(*) AS n_lines,
         sum(cast(l_quantity AS bigint)) AS qty,
         sum(cast(floor(l_discount * 100 + 0.5) AS bigint)) AS disc,
         sum(cast(floor(l_discount * 100 + 0.5) AS bigint) * cast(floor(l_discount * 100 + 0.5) AS bigint)) AS disc_sq,
         sum(cast(floor(l_tax * 100 + 0.5) AS bigint)) AS tax,
         sum(cast(floor(l_extendedprice * 100 + 0.5) AS bigint)) AS price,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returned
  FROM lineitem GROUP BY l_orderkey)"""

FEAT = f"""feat0 AS (
  SELECT date, product, count(*) AS n_orders,
         sum(cast(floor(o_totalprice * 100 + 0.5) AS bigint)) AS total,
         sum(n_lines) AS n_lines, sum(qty) AS qty, sum(disc) AS disc, sum(tax) AS tax,
         sum(price) AS price, sum(returned) AS returned
  FROM prop LEFT JOIN lines USING (o_orderkey) GROUP BY date, product),
feat AS (
  SELECT date, product, cast(n_orders AS double) AS {FEATURES[0]},
         cast(total AS double) / n_orders / 1e7 AS {FEATURES[1]},
         coalesce(cast(qty AS double) / cast(n_lines AS double), 0) AS {FEATURES[2]},
         coalesce(cast(disc AS double) / cast(n_lines AS double) / 100, 0) AS {FEATURES[3]},
         coalesce(cast(tax AS double) / cast(n_lines AS double) / 100, 0) AS {FEATURES[4]},
         coalesce(cast(price AS double) / cast(n_lines AS double) / 1e7, 0) AS {FEATURES[5]},
         coalesce(cast(returned AS double) / cast(n_lines AS double), 0) AS {FEATURES[6]}
  FROM feat0)"""

OUTC = """outc AS (
  SELECT date, product, config_hash, o_orderkey, cast(date + INTERVAL 7 DAY AS date) AS eval_date,
         mean_return, vol,
         CASE WHEN abs(vol) < 1e-12 THEN 0.0 ELSE mean_return / vol END AS meta_score
  FROM (SELECT prop.*, cast(disc - tax AS double) / n_lines / 100 AS mean_return,
               sqrt(cast(n_lines * disc_sq - disc * disc AS double)) / n_lines / 100 AS vol
        FROM prop JOIN lines USING (o_orderkey)))"""

DEC = """dec AS (
  SELECT cast(ts AS date) AS date, event_type AS product,
         substr(sha256(cast(user_id AS varchar)), 1, 16) AS config_hash,
         CASE event_id % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'modified' END AS decision,
         ts AS decided_at, CASE WHEN value > 10 THEN props END AS notes,
         CASE WHEN event_id % 3 = 2 THEN substr(sha256(cast(event_id AS varchar)), 1, 16) END AS modified_config_hash,
         event_id, user_id, value
  FROM events)"""

CELLS = """cells AS (
  SELECT cast(label AS varchar) AS product, vec_id AS t,
         cast(unnest(range(len(embedding))) AS bigint) AS idx,
         cast(unnest(embedding) AS double) AS value
  FROM embeddings)"""

WPROP = """wprop AS (
  SELECT cast(DATE '2000-01-01' + cast(('0x' || substr(sha256(cast(vec_id AS varchar)), 1, 2)) AS integer) AS date) AS date,
         cast(label AS varchar) AS product, substr(sha256(cast(vec_id AS varchar)), 1, 16) AS config_hash,
         CASE WHEN substr(sha256(cast(vec_id AS varchar)), 3, 1) <= '7' THEN 'best' ELSE 'alt' END AS proposal_type,
         vec_id
  FROM embeddings),
wlong AS (
  SELECT t AS vec_id, idx, abs(value) / sum(abs(value)) OVER (PARTITION BY t) AS w FROM cells)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def uniform(key: str) -> str:
    return f"(cast(('0x' || substr(sha256({key}), 1, 13)) AS bigint) / 4503599627370496.0::double)"


def normal(key: str) -> str:
    u = f"((cast(('0x' || substr(sha256({key} || '|u1'), 1, 13)) AS bigint) + 1) / 4503599627370496.0::double)"
    return f"(sqrt(-2.0::double * ln({u})) * cos(2.0::double * pi() * {uniform(key + " || '|u2'")}))"


def key_text(seed: object, *parts: str) -> str:
    return " || '|' || ".join([f"'{seed}'", *[f"cast({p} AS varchar)" for p in parts]])


def family_name(column: str = "family") -> str:
    cases = " ".join(f"WHEN '{p}' THEN '{f}'" for p, f in zip(PRIORITIES, FAMILIES))
    return f"CASE {column} {cases} END"


def product_name(column: str = "product") -> str:
    return f"CASE {column} WHEN 'F' THEN 'gamma' WHEN 'O' THEN 'vol' ELSE {column} END"


def training(as_of: str) -> str:
    """Row-level training table, features included."""
    return f"""train AS (
  SELECT p.*, {', '.join('f.' + f for f in FEATURES)}, o.eval_date, o.mean_return, o.vol, o.meta_score
  FROM prop p JOIN feat f ON p.date = f.date AND p.product = f.product
  JOIN outc o ON p.date = o.date AND p.product = o.product AND p.config_hash = o.config_hash
  WHERE o.eval_date <= DATE '{as_of}')"""


def scaler(source: str = "train", keys: str = "product", out: str = "scal") -> str:
    cells = []
    for i, f in enumerate(FEATURES):
        cells.append(f"avg({f}) AS mean_{i}")
        cells.append(
            f"CASE WHEN stddev_pop({f}) < 1e-12 THEN 1.0 ELSE stddev_pop({f}) END AS std_{i}"
        )
    return f"{out} AS (SELECT {keys}, count(*) AS n_rows, {', '.join(cells)} FROM {source} GROUP BY {keys})"


def z_columns() -> str:
    return ", ".join(
        ["1.0::double AS z_0"]
        + [f"({f} - mean_{i}) / std_{i} AS z_{i + 1}" for i, f in enumerate(FEATURES)]
    )


def standardised() -> str:
    return f"z AS (SELECT train.*, {z_columns()} FROM train JOIN scal USING (product))"


def gram(keys: str = "product, family", source: str = "z", y: str = "meta_score") -> str:
    cells = [f"sum(z_{i} * z_{j}) AS g_{i}_{j}" for i in range(DIM) for j in range(i, DIM)]
    cells += [f"sum(z_{i} * {y}) AS h_{i}" for i in range(DIM)]
    return f"gram AS (SELECT {keys}, count(*) AS n, {', '.join(cells)} FROM {source} GROUP BY {keys})"


def precision(keys: str, spine: str, extra: str = "", on: str = "") -> str:
    """Full matrix m0_i_j with the moment vector as column DIM; arms without rows keep the prior."""
    cells = []
    for i in range(DIM):
        for j in range(DIM):
            g = f"coalesce(g_{min(i, j)}_{max(i, j)}, 0) / 0.16"
            ridge = " + 1.0 + CASE WHEN coalesce(n, 0) > 0 THEN 1e-6 ELSE 0 END" if i == j else ""
            cells.append(f"{g}{ridge} AS m_{i}_{j}")
        cells.append(f"coalesce(h_{i}, 0) / 0.16 AS m_{i}_{DIM}")
    return (
        f"m0 AS (SELECT {keys}, coalesce(n, 0) AS n, {', '.join(cells)}{extra} "
        f"FROM {spine} LEFT JOIN gram {on or 'USING (product, family)'})"
    )


def eliminate(keys: str, width: int) -> str:
    """Gauss-Jordan stages m1 … m<DIM> on columns up to `width`; solutions end in columns >= DIM."""
    stages = []
    for p in range(DIM):
        cells = []
        for i in range(DIM):
            for j in range(p + 1, width):
                if i == p:
                    cells.append(f"m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}")
                else:
                    cells.append(f"m_{i}_{j} - m_{i}_{p} * m_{p}_{j} / m_{p}_{p} AS m_{i}_{j}")
        stages.append(f"m{p + 1} AS (SELECT {keys}, n, {', '.join(cells)} FROM m{p})")
    return ",\n".join(stages)


def arms_spine(source: str, families: list[str] = PRIORITIES) -> str:
    """`spine`: every family for every row of `source`."""
    values = ", ".join(f"('{f}')" for f in families)
    return f"spine AS (SELECT s.*, v.family FROM {source} s, (VALUES {values}) v(family))"


def x_cells(first: int) -> str:
    """Context vector as right-hand side column `first`, from features and scaler columns."""
    cells = [f"1.0::double AS m_0_{first}"]
    cells += [
        f"coalesce(({f} - mean_{i}) / std_{i}, 0) AS m_{i + 1}_{first}" for i, f in enumerate(FEATURES)
    ]
    cells += ["1.0::double AS x_0"]
    cells += [f"coalesce(({f} - mean_{i}) / std_{i}, 0) AS x_{i + 1}" for i, f in enumerate(FEATURES)]
    return ", " + ", ".join(cells)


def predicted(keys: str) -> str:
    """`pred`: posterior mean and deviation at the context carried as x_i."""
    mean = " + ".join(f"x_{i} * m_{i}_{DIM}" for i in range(DIM))
    var = " + ".join(f"x_{i} * m_{i}_{DIM + 1}" for i in range(DIM))
    return (
        f"pred AS (SELECT {keys}, n AS n_obs, {mean} AS posterior_mean, "
        f"sqrt({var}) AS posterior_std FROM m{DIM})"
    )


def x_names() -> str:
    return ", ".join(f"x_{i}" for i in range(DIM))


def drawn(seed: object) -> str:
    key = key_text(seed, "date", "product", "family")
    return f"drawn AS (SELECT *, posterior_mean + posterior_std * {normal(key)} AS sampled_value FROM pred)"


SLOTS = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY date, product ORDER BY sampled_value DESC, family) AS arm_rank FROM drawn),
slots AS (
  SELECT date, product, family, n_obs, posterior_mean, posterior_std,
         sampled_value AS thompson_sample_value, arm_rank,
         CASE WHEN arm_rank = 1 THEN 'best' WHEN arm_rank <= 3 THEN 'alt' ELSE 'explore' END AS proposal_type,
         least(arm_rank, 4) AS slot
  FROM (SELECT *, row_number() OVER (PARTITION BY date, product, arm_rank > 3
                                     ORDER BY posterior_std DESC, arm_rank) AS r FROM ranked)
  WHERE arm_rank <= 3 OR r = 1)"""

# Latest feature row per product on or before the cut-off stands in for today.
def contexts(as_of: str) -> str:
    return (
        f"ctx AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY product ORDER BY date DESC) AS r "
        f"FROM feat WHERE date <= DATE '{as_of}') WHERE r = 1)"
    )


def cholesky(keys: str) -> str:
    """Columns l_i_j of the lower factor of m_i_j, one stage for each column, ending in l<DIM>; n and m_i_DIM stay."""
    kept = [f"m_{i}_{j}" for i in range(DIM) for j in range(i + 1)] + [f"m_{i}_{DIM}" for i in range(DIM)]
    stages, source, made = [], "m0", []
    for j in range(DIM):
        less = "".join(f" - l_{j}_{k} * l_{j}_{k}" for k in range(j))
        stages.append(f"p{j} AS (SELECT {keys}, n, {', '.join(kept + made)}, sqrt(m_{j}_{j}{less}) AS l_{j}_{j} FROM {source})")
        made = [*made, f"l_{j}_{j}"]
        cells = []
        for i in range(j + 1, DIM):
            less = "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            cells.append(f"(m_{i}_{j}{less}) / l_{j}_{j} AS l_{i}_{j}")
        stages.append(f"l{j + 1} AS (SELECT {', '.join([keys, 'n', *kept, *made, *cells])} FROM p{j})")
        made, source = [*made, *[f"l_{i}_{j}" for i in range(j + 1, DIM)]], f"l{j + 1}"
    return ",\n".join(stages)


def drawn_weights(keys: str, seed: object, *parts: str) -> str:
    """`weights`: w_0 … w_7, the lower factor's forward and the upper one's backward substitution with keyed normals between."""
    factor = [f"l_{i}_{j}" for i in range(DIM) for j in range(i + 1)]
    stages, source, made = [], f"l{DIM}", []
    for i in range(DIM):
        less = "".join(f" - l_{i}_{k} * y_{k}" for k in range(i))
        own = f"(m_{i}_{DIM}{less}) / l_{i}_{i} AS y_{i}"
        kept = [keys, "n", *factor, *[f"m_{k}_{DIM}" for k in range(DIM)], *made]
        stages.append(f"y{i} AS (SELECT {', '.join(kept)}, {own} FROM {source})")
        made, source = [*made, f"y_{i}"], f"y{i}"
    right, made = made, []
    for i in reversed(range(DIM)):
        less = "".join(f" - l_{k}_{i} * w_{k}" for k in range(i + 1, DIM))
        z = normal(key_text(seed, *parts, str(i)))
        stages.append(f"w{i} AS (SELECT {', '.join([keys, 'n', *factor, *right, *made])}, (y_{i} + {z}{less}) / l_{i}_{i} AS w_{i} FROM {source})")
        made, source = [*made, f"w_{i}"], f"w{i}"
    return ",\n".join(stages) + f",\nweights AS (SELECT {keys}, n, {', '.join(f'w_{i}' for i in range(DIM))} FROM w0)"
