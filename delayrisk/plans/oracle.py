"""DuckDB oracle SQL for the registered queries.

Each string runs on DuckDB with the driver tables pre-registered as views.
The freight tables are defined inline as CTEs (FIXTURES.md section 3), so
every oracle query reads the whole driver tables, like its Spark twin.
The SQL is written from the reference's documented semantics, not from
our Spark code, so the two can disagree when one of them is wrong.
"""

from __future__ import annotations

# Freight tables over the driver tables (FIXTURES.md section 3).
ADAPTER = {
    "masterbill": "select o_orderkey as masterbill_internal_id from orders",
    "activity": """select l_orderkey as masterbill_internal_id,
  case when l_linestatus = 'O' and l_linenumber = 7 then null
       else o_orderdate + cast(l_quantity as int) * interval '1' day end as completion_date,
  case when l_returnflag = 'R' and l_linenumber = 6 then null
       when abs(c_nationkey - 12) >= 10 then o_orderdate + interval '30' day
       when abs(c_nationkey - 12) >= 7 then o_orderdate + interval '38' day
       when abs(c_nationkey - 12) >= 4 then o_orderdate + interval '44' day
       else o_orderdate + interval '48' day end as planned_date
from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
    "carrier": """select o_orderkey as masterbill_internal_id,
  case when c_acctbal < 0 then null
       else cast(abs(c_nationkey - 12) * 100 + c_custkey % 100 as double) end as distance_km
from orders join customer on o_custkey = c_custkey
union all select o_orderkey, cast(1 as double) from orders where o_orderpriority = '1-URGENT'""",
    "item_dimension": """select l_orderkey as masterbill_internal_id,
  case when l_linenumber in (1, 4) then 'height' when l_linenumber in (2, 5) then 'width'
       when l_linenumber in (3, 6) then 'length' else 'inch' end as dimension_dim,
  cast(p_size as double) as dimension
from lineitem join part on l_partkey = p_partkey""",
    "item_weight": """select l_orderkey as masterbill_internal_id,
  case when l_returnflag = 'N' then 'billed' else 'actual' end as weight_type, l_quantity as weight
from lineitem""",
    "itemgroup_line_item": """select l_orderkey as masterbill_internal_id,
  case when p_type = 'PROMO' then 'true' when p_type = 'SMALL' then null else 'false' end
    as hazardous_material_flag,
  case when l_linenumber = 5 then null else p_name end as description
from lineitem join part on l_partkey = p_partkey""",
    "item_group": """select o_orderkey as masterbill_internal_id,
  case when c_acctbal < 0 then null else c_mktsegment end as description
from orders join customer on o_custkey = c_custkey""",
    "masterbill_margins": """select o_orderkey as masterbill_internal_id,
  case when o_orderstatus = 'P' then 'PlannedMargin' else 'CurrentMargin' end as margin_type,
  o_totalprice as margin_value from orders""",
    "tracking_shipment_status": """select event_id as masterbill_internal_id,
  case when event_type = 'purchase' then 'Drop' when event_type = 'signup' then 'Pickup'
       else 'InTransit' end as event_type
from events""",
    "event": """select l_orderkey as master_bill_internal_id, 'Pickup' as event_type, s_name as city,
  n_name as state, r_name as country_code, cast(s_suppkey as varchar) as postal_code
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
union all
select o_orderkey, 'Drop', case when c_acctbal < 0 then null else c_name end, n_name, r_name,
  cast(c_custkey as varchar)
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  join region on n_regionkey = r_regionkey
union all
select o_orderkey, 'Booked', null, null, null, null from orders where o_orderpriority = '5-LOW'""",
    "fact_load": """select o_orderkey as masterbill_internal_id,
  o_orderkey * 10 + cast(l_linestatus = 'O' as bigint) as load_id,
  o_orderpriority as carrier_name, c_mktsegment as mode
from (select distinct l_orderkey, l_linestatus from lineitem)
  join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey""",
}


def draw(salt: str, id_expr: str = "masterbill_internal_id") -> str:
    """DuckDB twin of ``functions.draws.draw`` (first 8 hex digits of md5)."""
    return (f"cast('0x' || substr(md5('{salt}:' || coalesce(cast({id_expr} as varchar), '')), 1, 8)"
            f" as bigint)")


def with_ctes(ctes: list[tuple[str, str]], body: str) -> str:
    """``WITH a AS (...), b AS (...) body``, adapter views pulled in by name."""
    return "with " + ",\n".join(f"{n} as (\n{sql}\n)" for n, sql in ctes) + "\n" + body


def adapter(*names: str) -> list[tuple[str, str]]:
    return [(n, ADAPTER[n]) for n in names]


def forest_fit(source: str, features: tuple[str, ...], trees: int, depth: int, seed: int, bins: int,
               bounds: tuple[int, ...], per_hash: int, tried: int) -> list[tuple[str, str]]:
    """CTEs that fit ``operators.forest`` on ``source`` (id, features, delivery_delay); the last, ``nodes``, is the node table."""
    num = [f"coalesce(cast({f} as double), 0.0)" for f in features]
    weight = " + ".join(f"cast(b >= {x} as int)" for x in bounds)
    ctes = [
        ("fr", "select *, row_number() over (order by id, " + ", ".join(f"f{k}" for k in range(len(num))) + ", y) as rid from ("
         "select masterbill_internal_id as id, " + ", ".join(f"{x} as f{k}" for k, x in enumerate(num))
         + f", cast(delivery_delay <> 'Delayed' as int) as y from {source} where delivery_delay is not null)"),
        ("xl", " union all ".join(f"select rid, {k} as k, f{k} as v from fr" for k in range(len(num)))),
        ("rk", "select k, v, row_number() over (partition by k order by v) - 1 as r, count(*) over (partition by k) as n from xl"
         " where not isnan(v)"),
        ("cuts", "select k, v as cut, row_number() over (partition by k order by v) - 1 as b from (select distinct k, v"
         f" from rk join range(1, {bins}) q(q) on r = ((n - 1) * q) // {bins})"),
        ("vb", "select x.k, x.v, count(c.cut) as bin from (select distinct k, v from xl) x left join cuts c"
         " on c.k = x.k and c.cut < x.v group by 1, 2"),
        ("xb", "select rid, k, v, bin from xl join vb using (k, v)"),
        ("boot", "select rid, y, t, " + weight + " as w from (select rid, y, t, cast('0x' || substr(md5("
         f"'{seed}:' || (t // {per_hash}) || ':' || coalesce(cast(id as varchar), '')), 2 * (t % {per_hash}) + 1, 2) as int) as b"
         f" from fr, range({trees}) t(t))"),
        ("at0", "select rid, y, t, w, 1 as node from boot where w > 0"),
    ]
    for n in range(depth + 1):
        ctes.append((f"tot{n}", f"select t, node, sum(case when y = 0 then w else 0 end)::bigint as late,"
                                f" sum(case when y = 1 then w else 0 end)::bigint as timely from at{n} group by t, node"))
        if n == depth:
            break
        ctes += [
            (f"h{n}", f"select t, node, k, bin, sum(case when y = 0 then w else 0 end)::bigint as a,"
                      f" sum(case when y = 1 then w else 0 end)::bigint as c from at{n} join xb using (rid) group by all"),
            (f"cum{n}", "select t, node, k, bin, (sum(a) over s)::bigint as a, (sum(c) over s)::bigint as c"
                        f" from h{n} window s as (partition by t, node, k order by bin)"),
            (f"try{n}", f"select t, node, k from (select t, node, k, row_number() over (partition by t, node order by"
                        f" md5('{seed}:' || t || ':' || node || ':' || k)) as place from tot{n}, range({len(num)}) k(k)) where place <= {tried}"),
            (f"gain{n}", "select t, node, k, b, cut, (a * a + c * c)::double / (a + c) + ((late - a) * (late - a)"
                         " + (timely - c) * (timely - c))::double / (late - a + timely - c) as gain,"
                         " (late * late + timely * timely)::double / (late + timely) as plain"
                         f" from cum{n} join try{n} using (t, node, k) join cuts on cuts.k = cum{n}.k and cuts.b = cum{n}.bin"
                         f" join tot{n} using (t, node) where a + c > 0 and a + c < late + timely"),
            (f"split{n}", f"select t, node, k, cut from (select *, row_number() over (partition by t, node order by gain desc, k, b)"
                          f" as place from gain{n} where gain > plain) where place = 1"),
            (f"at{n + 1}", f"select a.rid, a.y, a.t, a.w, 2 * a.node + cast(x.v > s.cut as int) as node from at{n} a"
                           f" join split{n} s using (t, node) join xl x on x.rid = a.rid and x.k = s.k"),
        ]
    every = " union all ".join(
        f"select tot{n}.*, " + ("k, cut" if n < depth else "null as k, null as cut") + f" from tot{n}"
        + (f" left join split{n} using (t, node)" if n < depth else "") for n in range(depth + 1))
    names = "[" + ", ".join(f"'{f}'" for f in features) + "]"
    ctes.append(("nodes", f"select t::int as tree, node::int as node, {names}[k + 1] as feature, k, cut, late, timely from ({every})"))
    return ctes


def forest_walk(source: str, features: tuple[str, ...], trees: int, depth: int) -> list[tuple[str, str]]:
    """CTEs that score ``source`` by ``nodes``; the last, ``sc``, has its columns, the class and the risk."""
    num = [f"coalesce(cast({f} as double), 0.0)" for f in features]
    ctes = [("sr", f"select *, row_number() over (order by masterbill_internal_id, {', '.join(features)}) as rid, [{', '.join(num)}] as x from {source}"),
            ("go0", f"select rid, x, t as tree, 1 as node from sr, range({trees}) t(t)")]
    for n in range(depth):
        ctes.append((f"go{n + 1}", f"select rid, x, tree, case when cut is null then node else 2 * node + cast(x[k + 1] > cut as int) end"
                                   f" as node from go{n} join nodes using (tree, node)"))
    ctes += [
        ("rs", "select rid, list_reduce(list(case when late + timely > 0 then late::double / (late + timely) else 0.5 end order by tree),"
         f" lambda a, b: a + b) / {float(trees)}::double * 100.0::double as risk_factor from go{depth} join nodes using (tree, node) group by rid"),
        ("sc", "select sr.* exclude (rid, x), case when risk_factor >= 50 then 'Delayed' else 'Not Delayed' end as delivery_delay,"
         " risk_factor from sr join rs using (rid)"),
    ]
    return ctes
