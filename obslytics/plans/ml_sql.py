"""SQL twins of the deterministic models: k-means as a chain of rounds, Jacobi rotations as a chain of one-row tables."""

from __future__ import annotations

from collections.abc import Sequence


def kmeans(points: str, key: str, cols: Sequence[str], k: int, rounds: int, name: str = "km") -> str:
    """CTEs over the table ``points``: ``{name}_centres`` (cluster, columns) and ``{name}_rows`` (points, cluster, distance)."""
    d = " + ".join(f"(p.{c} - z.{c}) * (p.{c} - z.{c})" for c in cols)
    list_ = ", ".join(cols)
    hashed = f"md5(coalesce(cast(p.{key} AS VARCHAR), ''))"
    out = [f"{name}_c1 AS MATERIALIZED (SELECT 0::BIGINT AS cluster, {list_} FROM {points} p ORDER BY {hashed} LIMIT 1)"]
    for i in range(2, k + 1):
        out.append(f"""{name}_c{i} AS MATERIALIZED (SELECT * FROM {name}_c{i - 1} UNION ALL SELECT * FROM (
  SELECT {i - 1}::BIGINT AS cluster, {', '.join('p.' + c for c in cols)} FROM {points} p, {name}_c{i - 1} z GROUP BY p.{key}, {', '.join('p.' + c for c in cols)}
  ORDER BY min(round({d}, 9)) DESC, {hashed} LIMIT 1))""")
    centres = f"{name}_c{k}"
    def near(centres: str) -> str:
        return f"""SELECT p.{key} AS k_key, {', '.join(f'p.{c} AS {c}' for c in cols)}, min({{'near': round({d}, 9), 'cluster': z.cluster, 'distance': {d}}}) AS near
  FROM {points} p, {centres} z GROUP BY p.{key}, {', '.join('p.' + c for c in cols)}"""

    for r in range(1, rounds + 1):
        out.append(f"{name}_a{r} AS MATERIALIZED ({near(centres)})")
        out.append(f"""{name}_r{r} AS MATERIALIZED (SELECT z.cluster, {', '.join(f'coalesce(avg(a.{c}), any_value(z.{c})) AS {c}' for c in cols)}
  FROM {centres} z LEFT JOIN {name}_a{r} a ON a.near.cluster = z.cluster GROUP BY z.cluster)""")
        centres = f"{name}_r{r}"
    out.append(f"{name}_centres AS MATERIALIZED (SELECT * FROM {centres})")
    out.append(f"{name}_rows AS MATERIALIZED (SELECT k_key AS {key}, {list_}, near.cluster AS cluster, near.distance AS distance FROM ({near(centres)}))")
    return ",\n".join(out)


def components(points: str, cols: Sequence[str], sweeps: int, name: str = "pc") -> str:
    """CTEs over ``points``: ``{name}_components`` (component, feature, loading, ratio, mean) with the fixed signs."""
    n = len(cols)
    entries = [(i, j) for i in range(n) for j in range(n)]
    first = ", ".join([*(f"coalesce(covar_samp({cols[i]}, {cols[j]}), 0) AS a{i}{j}" for i, j in entries),
                       *(f"{float(i == j)}::DOUBLE AS v{i}{j}" for i, j in entries), *(f"avg({c}) AS m{i}" for i, c in enumerate(cols))])
    means = ", ".join(f"m{i}" for i in range(n))
    out, last, step = [f"{name}_0 AS MATERIALIZED (SELECT {first} FROM {points})"], f"{name}_0", 0
    for _ in range(sweeps):
        for p in range(n):
            for q in range(p + 1, n):
                step += 1
                theta = f"((a{q}{q} - a{p}{p}) / (2 * a{p}{q}))"
                t = f"CASE WHEN abs(a{p}{q}) < 1e-300 THEN 0 ELSE (CASE WHEN {theta} >= 0 THEN 1 ELSE -1 END) / (abs({theta}) + sqrt({theta} * {theta} + 1)) END"
                turned = []  # columns first, then rows
                for m in "av":
                    for i in range(n):
                        turned += [f"c * {m}{i}{p} - s * {m}{i}{q} AS {m}{i}{p}", f"s * {m}{i}{p} + c * {m}{i}{q} AS {m}{i}{q}"]
                        turned += [f"{m}{i}{j}" for j in range(n) if j not in (p, q)]
                rows = [f"c * a{p}{j} - s * a{q}{j} AS a{p}{j}" for j in range(n)] + [f"s * a{p}{j} + c * a{q}{j} AS a{q}{j}" for j in range(n)]
                rows += [f"a{i}{j}" for i, j in entries if i not in (p, q)] + [f"v{i}{j}" for i, j in entries]
                out.append(f"""{name}_{step} AS MATERIALIZED (SELECT {', '.join(rows)}, {means} FROM (SELECT {', '.join(turned)}, c, s, {means}
  FROM (SELECT *, 1 / sqrt(t * t + 1) AS c, t / sqrt(t * t + 1) AS s FROM (SELECT *, {t} AS t FROM {last}))))""")
                last = f"{name}_{step}"
    vectors = " UNION ALL ".join(
        f"SELECT {i} AS i, a{i}{i} AS value, [{', '.join(f'v{j}{i}' for j in range(n))}] AS vector, [{means}] AS means FROM {last}" for i in range(n))
    out.append(f"""{name}_ranked AS MATERIALIZED (SELECT row_number() OVER (ORDER BY value DESC, i) AS component, value / sum(value) OVER () AS ratio, vector, means,
  list_position(list_transform(vector, lambda x: round(abs(x), 9)), list_max(list_transform(vector, lambda x: round(abs(x), 9)))) AS top FROM ({vectors}))""")
    features = " UNION ALL ".join(f"SELECT {i + 1} AS place, '{c}' AS feature" for i, c in enumerate(cols))
    out.append(f"""{name}_components AS MATERIALIZED (SELECT component, ratio, feature, place, CASE WHEN vector[top] >= 0 THEN vector[place] ELSE -vector[place] END AS loading,
  means[place] AS mean FROM {name}_ranked, ({features}))""")
    return ",\n".join(out)
