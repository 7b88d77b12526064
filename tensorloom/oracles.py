"""DuckDB SQL of the queries of catalog.py."""

from __future__ import annotations

V = "SELECT vec_id AS tensor, unnest(range(len(embedding))) AS idx, unnest(embedding)::FLOAT AS v FROM embeddings"
M = "SELECT 'm' AS tensor, vec_id * 64 + unnest(range(len(embedding))) AS idx, unnest(embedding)::FLOAT AS v FROM embeddings"
LOOSE = " UNION ALL ".join(f"SELECT 'lineitem.{c}' AS tensor, {c}::FLOAT AS v FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
SMALLEST = "1.401298464324817e-45::FLOAT"


def ordered(table: str, key: str, column: str) -> str:
    return f"SELECT '{table}.{column}' AS tensor, {key} - (SELECT min({key}) FROM {table}) AS idx, {column}::FLOAT AS v FROM {table}"


ORDERS = ordered("orders", "o_orderkey", "o_totalprice")


def scale(amax: str, top: int) -> str:
    return f"CASE WHEN coalesce({amax}, 0) = 0 THEN 1::FLOAT WHEN ({amax} / {top}::FLOAT)::FLOAT = 0 THEN {SMALLEST} ELSE ({amax} / {top}::FLOAT)::FLOAT END"


def level(v: str, s: str, top: int) -> str:
    return f"greatest(-{top}, least({top}, round(({v} / {s})::FLOAT)))::TINYINT"


def quantized(rows: str, top: int, size: int = 0) -> str:
    """tensor, idx, v, grp, scale, q, v_hat."""
    grp = f"idx // {size}" if size else "0"
    has = "idx" if " idx" in rows else "0 AS idx"
    return f"""
      SELECT *, (q::FLOAT * scale)::FLOAT AS v_hat FROM (
        SELECT *, {level("v", "scale", top)} AS q FROM (
          SELECT tensor, idx, v, grp, {scale("max(abs(v)) OVER (PARTITION BY tensor, grp)", top)} AS scale
          FROM (SELECT tensor, {has}, v, {grp if "idx" in has and " idx" in rows else "0"} AS grp FROM ({rows}))))"""


def metrics(by: str, extra: str = "", mse: str = "1e12", sqnr: str = "1e6", suffix: tuple[str, str] = ("e12", "e6")) -> str:
    e = "(v::DOUBLE - v_hat::DOUBLE)"
    keys = f"{by}, " if by else ""
    return f"""{keys}count(*)::BIGINT AS elements, floor(avg({e} * {e}) * {mse} + 0.5)::BIGINT AS mse_{suffix[0]},
      floor(avg(abs({e})) * {mse} + 0.5)::BIGINT AS mae_{suffix[0]}, max(abs({e})) AS max_abs_error,
      floor(CASE WHEN sum(v::DOUBLE * v::DOUBLE) > 0 AND sum({e} * {e}) > 0
        THEN 10 * log10(sum(v::DOUBLE * v::DOUBLE) / sum({e} * {e})) END * {sqnr} + 0.5)::BIGINT AS sqnr_{suffix[1]}{extra}"""


def f16(x: str) -> str:
    e = f"greatest(floor(log2({x}::DOUBLE)), -14)"
    return f"CASE WHEN {x} = 0 THEN 0 WHEN {x} >= 65520 THEN 'inf'::DOUBLE ELSE round_even({x}::DOUBLE / pow(2, {e} - 10), 0) * pow(2, {e} - 10) END"


def q8(rows: str) -> str:
    """tensor, idx, v, grp, scale, q, v_hat."""
    return f"""
  SELECT *, (q::FLOAT * scale)::FLOAT AS v_hat FROM (
    SELECT tensor, idx, v, grp, ({f16("exact")})::FLOAT AS scale,
      greatest(-127, least(127, round((v * CASE WHEN exact = 0 THEN 0::FLOAT ELSE (1::FLOAT / exact)::FLOAT END)::FLOAT)))::TINYINT AS q
    FROM (SELECT *, (max(abs(v)) OVER (PARTITION BY tensor, idx // 32) / 127::FLOAT)::FLOAT AS exact, idx // 32 AS grp FROM ({rows})))"""


Q8 = q8(M)


def fp8(v: str, mantissa: int, bias: int, top: int, inf: int) -> str:
    """Code of a value that is not NaN."""
    x, low = f"abs({v}::DOUBLE)", 1 - bias
    e = f"greatest(floor(log2({x})), {low})"
    near = f"least(round_even({x} / pow(2, {e} - {mantissa}), 0) * pow(2, {e} - {mantissa}), {top})"
    k = f"floor(log2({near}))"
    code = f"CASE WHEN {x} = 0 THEN 0 WHEN isinf({v}) THEN {inf} WHEN {near} = 0 THEN 0 WHEN {near} < pow(2, {low}) THEN {near} * pow(2, {mantissa - low}) ELSE ({k} + {bias}) * {1 << mantissa} + ({near} / pow(2, {k}) - 1) * {1 << mantissa} END"
    return f"(({code})::BIGINT + CASE WHEN signbit({v}) THEN 128 ELSE 0 END)"


def e4m3(v: str) -> str:
    return fp8(v, 3, 7, 448, 0x7E)


def e5m2(v: str) -> str:
    return fp8(v, 2, 15, 57344, 0x7B)


def e2m1(v: str) -> str:
    x = f"abs({v}::DOUBLE)"
    steps = " + ".join(f"({x} {op} {c})::BIGINT" for op, c in ((">", 0.25), (">=", 0.75), (">", 1.25), (">=", 1.75), (">", 2.5), (">=", 3.5), (">", 5)))
    return f"({steps} + CASE WHEN signbit({v}) THEN 8 ELSE 0 END)"


E2M1_VALUE = "CASE c % 8 WHEN 0 THEN 0 WHEN 1 THEN 0.5 WHEN 2 THEN 1 WHEN 3 THEN 1.5 WHEN 4 THEN 2 WHEN 5 THEN 3 WHEN 6 THEN 4 ELSE 6 END::DOUBLE"


def fp8_value(c: str, mantissa: int, bias: int) -> str:
    """Magnitude of a finite code."""
    n = 1 << mantissa
    return f"CASE WHEN ({c} % 128) // {n} = 0 THEN ({c} % {n}) * pow(2, {1 - bias - mantissa}) ELSE (1 + ({c} % {n}) / {n}.0) * pow(2, ({c} % 128) // {n} - {bias}) END"


def decode_table(size: int, value: str, nan: str, inf: str, sign: int) -> str:
    return f"""SELECT c AS code, CASE WHEN {nan} THEN 'nan' WHEN {inf} THEN 'inf' ELSE 'finite' END AS kind,
      CASE WHEN NOT ({nan}) AND NOT ({inf}) THEN (CASE WHEN c >= {sign} THEN -1 ELSE 1 END) * ({value}) END AS value,
      c >= {sign} AND NOT ({nan}) AS negative FROM (SELECT range::BIGINT AS c FROM range({size}))"""


def fp4(rows: str) -> str:
    """tensor, idx, v, grp, block_bits, scale, global_scale, code and what they come from."""
    return f"""
  SELECT *, CASE WHEN block_bits = 0 THEN 0 ELSE {e2m1("((((v / g)::FLOAT * 2688::FLOAT)::FLOAT) / scale)::FLOAT")} END AS code FROM (
    SELECT *, CASE WHEN block_bits = 0 THEN 1 ELSE {fp8_value("block_bits", 3, 7)} END::FLOAT AS scale,
      CASE WHEN gmax = 0 THEN 1::FLOAT WHEN (gmax / 2688::FLOAT)::FLOAT = 0 THEN {SMALLEST} ELSE (gmax / 2688::FLOAT)::FLOAT END AS global_scale
    FROM (SELECT *, CASE WHEN bmax = 0 THEN 0 ELSE greatest(1, {e4m3("((bmax / g)::FLOAT * 448::FLOAT)::FLOAT")}) END AS block_bits
      FROM (SELECT *, CASE WHEN gmax = 0 THEN 1::FLOAT ELSE gmax END AS g
        FROM (SELECT *, idx // 16 AS grp, max(abs(v)) OVER (PARTITION BY tensor, idx // 16) AS bmax, max(abs(v)) OVER (PARTITION BY tensor) AS gmax FROM ({rows})))))"""


#: (e2m1 * e4m3) of a code in a block.
FP4_VALUE = f"((CASE WHEN code >= 8 THEN -1 ELSE 1 END) * {E2M1_VALUE.replace('c % 8', 'code % 8')})::FLOAT * CASE WHEN block_bits = 0 THEN 0::FLOAT ELSE scale END"


def fp4_back(rows: str) -> str:
    return f"SELECT *, (({FP4_VALUE})::FLOAT * global_scale)::FLOAT AS v_hat FROM ({fp4(rows)})"


FP4, FP4_BACK = fp4(M), fp4_back(M)

INTEGERS = {"orders.o_orderkey": "I64", "customer.c_custkey": "I64", "customer.c_nationkey": "I32", "part.p_size": "I32", "nation.n_nationkey": "I32", "region.r_regionkey": "I32"}
FLOATS = ("lineitem.l_quantity", "lineitem.l_extendedprice", "lineitem.l_discount", "lineitem.l_tax", "orders.o_totalprice", "customer.c_acctbal", "supplier.s_acctbal", "part.p_retailprice", "events.value")
TABLES = (
    " UNION ALL ".join(f"SELECT '{t}' AS tensor, '{k}' AS dtype, n::VARCHAR AS shape, n AS element_count, n * {8 if k == 'I64' else 4} AS byte_len FROM (SELECT count(*)::BIGINT AS n FROM {t.split('.')[0]})" for t, k in [*((f, "F32") for f in FLOATS), *INTEGERS.items()])
    + " UNION ALL SELECT 'embeddings.embedding', 'F32', n::VARCHAR || 'x64', n * 64, n * 256 FROM (SELECT count(*)::BIGINT AS n FROM embeddings)"
)


def decided(minimum: int = 1024) -> str:
    return f"""SELECT *, CASE WHEN dtype <> 'F32' THEN 'NonFloating' WHEN element_count = 0 THEN 'EmptyTensor' WHEN element_count >= {minimum} THEN 'FloatingMeetsMinimum' ELSE 'FloatingBelowMinimum' END AS reason_code,
      CASE WHEN dtype = 'F32' THEN 'floating' ELSE 'non-floating' END AS kind,
      CASE WHEN dtype = 'F32' AND element_count > 0 AND element_count >= {minimum} THEN 'quantize' ELSE 'preserve' END AS action FROM ({TABLES})"""


def plan(only: str = "true") -> str:
    rows = f"SELECT * FROM ({decided()}) WHERE {only}"
    return f"""
  SELECT row_number() OVER (ORDER BY source_name, k) - 1 AS ord, name, source_name, dtype, byte_len,
    (sum(byte_len) OVER (ORDER BY source_name, k ROWS UNBOUNDED PRECEDING) - byte_len)::BIGINT AS data_start,
    (sum(byte_len) OVER (ORDER BY source_name, k ROWS UNBOUNDED PRECEDING))::BIGINT AS data_end, role
  FROM (
    SELECT tensor AS source_name, tensor AS name, 0 AS k, dtype, byte_len, 'preserved' AS role FROM ({rows}) WHERE action = 'preserve'
    UNION ALL SELECT tensor, tensor || '.qdata', 0, 'I8', element_count, 'qdata' FROM ({rows}) WHERE action = 'quantize'
    UNION ALL SELECT tensor, tensor || '.scale', 1, 'F32', 4, 'scale' FROM ({rows}) WHERE action = 'quantize')"""


PLAN = plan()

PACKED = "lpad(lower(to_hex(coalesce(max({c}) FILTER (idx % 2 = 0), 0)::BIGINT & 15 | ((coalesce(max({c}) FILTER (idx % 2 = 1), 0)::BIGINT & 15) << 4))), 2, '0')"
VALUES = " UNION ALL ".join(f"SELECT '{f}' AS tensor, {f.split('.')[1]}::FLOAT AS v FROM {f.split('.')[0]}" for f in FLOATS) + " UNION ALL SELECT 'embeddings.embedding', unnest(embedding)::FLOAT FROM embeddings"
#: Values of the tensors that the policy quantizes.
REPORT_VALUES = f"SELECT * FROM ({VALUES}) WHERE tensor IN (SELECT tensor FROM ({decided()}) WHERE action = 'quantize')"
DIAGNOSTICS = "count(*)::BIGINT * 4 AS source_bytes"
SATURATED = "count(*) FILTER (abs(q::INTEGER) = {top})::BIGINT AS saturated_values"
FORMATS = f"""SELECT 'int8' AS format, v, v_hat FROM ({quantized(M, 127)}) UNION ALL SELECT 'int4_32', v, v_hat FROM ({quantized(M, 7, 32)})
  UNION ALL SELECT 'q8_0', v, v_hat FROM ({Q8}) UNION ALL SELECT 'nvfp4', v, v_hat FROM ({FP4_BACK})"""
BAD = "CASE WHEN (tensor * 64 + idx) % 97 = 5 THEN 'nan'::FLOAT WHEN (tensor * 64 + idx) % 131 = 7 THEN '-inf'::FLOAT ELSE v END"
ROUNDTRIP8 = f"""SELECT {metrics("tensor", ", " + SATURATED.format(top=127) + ", " + DIAGNOSTICS + ", count(*)::BIGINT + 4 AS quantized_bytes, (count(*) * 4) / (count(*) + 4)::DOUBLE AS compression_ratio")} FROM ({quantized(V, 127)}) GROUP BY tensor"""

#: The tensors of the container that is written from the tables, and sums over what must be read back.
CONTAINED = "tensor IN ('customer.c_acctbal', 'embeddings.embedding', 'nation.n_nationkey', 'orders.o_totalprice', 'part.p_retailprice', 'region.r_regionkey', 'supplier.s_acctbal')"
TOTALS = f"""
  SELECT tensor || '.qdata' AS name, sum(q)::BIGINT AS total FROM ({quantized(VALUES, 127)}) GROUP BY tensor
  UNION ALL SELECT tensor || '.scale', floor(max(scale)::DOUBLE * 1e6 + 0.5)::BIGINT FROM ({quantized(VALUES, 127)}) GROUP BY tensor
  UNION ALL SELECT tensor, sum(floor(v::DOUBLE * 1e6 + 0.5)::BIGINT)::BIGINT FROM ({VALUES}) GROUP BY tensor
  UNION ALL SELECT 'nation.n_nationkey', sum(n_nationkey)::BIGINT FROM nation
  UNION ALL SELECT 'region.r_regionkey', sum(r_regionkey)::BIGINT FROM region"""
CONTAINER = f"SELECT p.name AS tensor, p.dtype, p.byte_len, p.data_start, p.data_end, t.total FROM ({plan(CONTAINED)}) p JOIN ({TOTALS}) t ON p.name = t.name"
SHAPE = "'[' || replace(shape, 'x', ',') || ']'"
RECORD = f"""'"' || tensor || '":{{"action":"' || CASE action WHEN 'quantize' THEN 'quantized' ELSE 'preserved' END || '","original_dtype":"' || dtype || '","original_shape":' || {SHAPE} ||
  CASE action WHEN 'quantize' THEN ',"qdata_dtype":"I8","qdata_name":"' || tensor || '.qdata","scale_dtype":"F32","scale_name":"' || tensor || '.scale","scale_shape":[]}}' ELSE ',"tensor_name":"' || tensor || '"}}' END"""


def first(code: str, where: str, idx: str = "0", n: str = "1") -> str:
    """A violation of every vector that where names."""
    return f"SELECT vec_id AS tensor, '{code}' AS code, {idx}::BIGINT AS idx, {n}::BIGINT AS n FROM embeddings WHERE vec_id % 8 {where}"


def overflowing(rows: str, damaged: int, too_large: str) -> str:
    return f"SELECT tensor, 'DequantizedValueOverflow', min(idx), count(*) FROM ({rows}) WHERE tensor % 8 = {damaged} AND {too_large} GROUP BY tensor"


SQL: dict[str, str] = {
    "int8_scale_per_vector": f"SELECT tensor, ({scale('max(abs(v))', 127)})::DOUBLE AS scale FROM ({V}) GROUP BY tensor",
    "int8_quantize_values": f"SELECT tensor, idx, q::BIGINT AS q FROM ({quantized(V, 127)})",
    "int8_dequantize": f"SELECT tensor, idx, v_hat::DOUBLE AS v_hat FROM ({quantized(V, 127)})",
    "int8_roundtrip_metrics": ROUNDTRIP8,
    "int8_roundtrip_elements": ROUNDTRIP8,
    "int8_roundtrip_columns": f"""SELECT {metrics("tensor", ", " + SATURATED.format(top=127) + ", count(*)::BIGINT + 4 AS quantized_bytes", "1e4", "1e5", ("e4", "e5"))} FROM ({quantized(LOOSE, 127)}) GROUP BY tensor""",
    "int8_saturation_count": f"SELECT tensor, {SATURATED.format(top=127)} FROM ({quantized(V, 127)}) GROUP BY tensor",
    "int8_global_scale_matrix": f"SELECT q::BIGINT AS q, count(*) AS n, max(scale)::DOUBLE AS scale FROM ({quantized(M, 127)}) GROUP BY q",
    "int8_parallel": f"SELECT idx, q::BIGINT AS q FROM ({quantized(M, 127)})",
    "int8_chunked_replay": f"SELECT idx // 16384 AS chunk, count(*) AS n, min(q)::BIGINT AS min_q, max(q)::BIGINT AS max_q, sum(q)::BIGINT AS sum_q FROM ({quantized(M, 127)}) GROUP BY 1",
    "int8_per_channel": f"SELECT grp, max(scale)::DOUBLE AS scale, sum(q)::BIGINT AS sum_q FROM ({quantized(M, 127, 64)}) GROUP BY grp",
    "int4_group_scales_32": f"SELECT idx // 32 AS grp, ({scale('max(abs(v))', 7)})::DOUBLE AS scale FROM ({M}) GROUP BY 1",
    "int4_group_scales_31": f"SELECT idx // 31 AS grp, ({scale('max(abs(v))', 7)})::DOUBLE AS scale FROM ({M}) GROUP BY 1",
    "int4_quantize_values": f"SELECT idx, q::BIGINT AS q FROM ({quantized(M, 7, 31)})",
    "int4_parallel": f"SELECT idx, q::BIGINT AS q FROM ({quantized(M, 7, 31)})",
    "int4_dequantize": f"SELECT idx, v_hat::DOUBLE AS v_hat FROM ({quantized(M, 7, 31)})",
    "int4_pack_hex": f"SELECT idx // 2 AS byte_idx, {PACKED.format(c='q')} AS hex FROM ({quantized(ORDERS, 7, 31)}) GROUP BY 1",
    "int4_unpack": f"SELECT idx, q::BIGINT AS q FROM ({quantized(ORDERS, 7, 128)})",
    "int4_roundtrip_metrics": f"""SELECT {metrics("tensor", ", " + SATURATED.format(top=7) + ", (ceil(count(*) / 2.0) + 4 * ceil(count(*) / 32.0))::BIGINT AS quantized_bytes, (count(*) * 4)::DOUBLE / (ceil(count(*) / 2.0) + 4 * ceil(count(*) / 32.0))::BIGINT AS compression_ratio")} FROM ({quantized(V, 7, 32)}) GROUP BY tensor""",
    "int4_array_scales": f"SELECT tensor, idx // 24 AS grp, ({scale('max(abs(v))', 7)})::DOUBLE AS scale FROM ({V}) GROUP BY ALL",
    "q8_0_block_scales": f"SELECT grp, max(scale)::DOUBLE AS scale, max({fp8('scale', 10, 15, 65504, 31744)})::BIGINT AS bits FROM ({Q8}) GROUP BY grp",
    "q8_0_quantize": f"SELECT idx, q::BIGINT AS q FROM ({Q8})",
    "q8_0_dequantize": f"SELECT idx, v_hat::DOUBLE AS v_hat FROM ({Q8})",
    "nvfp4_block_scales": f"SELECT grp, max(block_bits)::BIGINT AS block_bits, max(global_scale)::DOUBLE AS global_scale FROM ({FP4}) GROUP BY grp",
    "nvfp4_codes": f"SELECT idx, code::BIGINT AS code FROM ({FP4})",
    "nvfp4_pack_hex": f"SELECT idx // 2 AS byte_idx, {PACKED.format(c='code')} AS hex FROM ({FP4}) GROUP BY 1",
    "nvfp4_dequantize": f"SELECT idx, v_hat::DOUBLE AS v_hat FROM ({FP4_BACK})",
    "nvfp4_metrics": f"SELECT {metrics('tensor')} FROM ({FP4_BACK}) GROUP BY tensor",
    "fp4_e2m1_decode_table": decode_table(16, E2M1_VALUE, "false", "false", 8),
    "fp8_e4m3_decode_table": decode_table(256, fp8_value("c", 3, 7), "c % 128 = 127", "false", 128),
    "fp8_e5m2_decode_table": decode_table(256, fp8_value("c", 2, 15), "c % 128 > 124", "c % 128 = 124", 128),
    "float_encode_columns": f"SELECT idx, {e2m1('s')} AS e2m1, {e4m3('s')} AS e4m3_small, {e4m3('v')} AS e4m3, {e5m2('v')} AS e5m2 FROM (SELECT idx, v, (v * 0.001::FLOAT)::FLOAT AS s FROM ({ordered('customer', 'c_custkey', 'c_acctbal')}))",
    "codec_roundtrip_exhaustive": "SELECT 'e2m1' AS codec, range::BIGINT AS code, range::BIGINT AS back FROM range(16) UNION ALL SELECT 'e4m3', range, range FROM range(256) WHERE range % 128 <> 127 UNION ALL SELECT 'e5m2', range, range FROM range(256) WHERE range % 128 < 124",
    "policy_decisions": f"""SELECT tensor, element_count, kind, action, reason_code, CASE reason_code WHEN 'NonFloating' THEN 'non-floating tensors are preserved' WHEN 'EmptyTensor' THEN 'empty tensors are preserved'
      WHEN 'FloatingMeetsMinimum' THEN 'floating tensor has ' || element_count || ' elements, meeting minimum 1024' ELSE 'floating tensor has ' || element_count || ' elements, below minimum 1024' END AS reason_text FROM ({decided()})""",
    "policy_threshold_sweep": " UNION ALL ".join(f"SELECT {m}::BIGINT AS minimum_elements, action, count(*) AS n FROM ({decided(m)}) GROUP BY action" for m in (0, 100, 1024, 100_000)),
    "catalog_inspect": TABLES,
    "layout_plan": PLAN,
    "layout_contiguity_check": f"SELECT name AS tensor, data_start + 1 AS data_start, data_start AS expected FROM ({PLAN}) WHERE ord % 5 = 4",
    "layout_overlap_check": f"SELECT name AS tensor, data_start - 2 AS data_start FROM ({PLAN}) WHERE ord % 4 = 3",
    "layout_duplicate_check": f"SELECT tensor, 2::BIGINT AS n FROM ({TABLES}) WHERE tensor LIKE 'l%'",
    "decision_anti_joins": "SELECT * FROM (VALUES ('MissingDecision', 'events.value'), ('UnexpectedDecision', 'unknown'), ('DecisionElementCountMismatch', 'part.p_size')) x(code, tensor)",
    "compression_accounting": f"""SELECT tensor, source_bytes, format, total_bytes, source_bytes / nullif(total_bytes, 0)::DOUBLE AS ratio FROM (
      SELECT tensor, byte_len AS source_bytes, f.k AS format, f.b AS total_bytes FROM (SELECT *, unnest([
        {{'k': 'int8', 'b': element_count + 4}}, {{'k': 'int4_128', 'b': (ceil(element_count / 2.0) + 4 * ceil(element_count / 128.0))::BIGINT}},
        {{'k': 'q8_0', 'b': (ceil(element_count / 32.0) * 34)::BIGINT}}, {{'k': 'nvfp4', 'b': (ceil(element_count / 2.0) + ceil(element_count / 16.0) + 4)::BIGINT}}]) AS f FROM ({TABLES}) WHERE dtype = 'F32'))""",
    "compression_report": f"SELECT role, count(*) AS tensors, sum(byte_len)::BIGINT AS bytes FROM ({PLAN}) GROUP BY role",
    "model_report": f"""SELECT count(*) AS quantized_tensors, sum(saturated_values)::BIGINT AS saturated_values, floor(max(mse) * 1e3 + 0.5)::BIGINT AS max_mse_e3, floor(max(mae) * 1e3 + 0.5)::BIGINT AS max_mae_e3,
      max(mx) AS max_abs_error, floor(min(sq) * 1e5 + 0.5)::BIGINT AS lowest_sqnr_e5 FROM (
        SELECT tensor, avg((v::DOUBLE - v_hat::DOUBLE) ** 2) AS mse, avg(abs(v::DOUBLE - v_hat::DOUBLE)) AS mae, max(abs(v::DOUBLE - v_hat::DOUBLE)) AS mx,
          10 * log10(sum(v::DOUBLE * v::DOUBLE) / nullif(sum((v::DOUBLE - v_hat::DOUBLE) ** 2), 0)) AS sq, {SATURATED.format(top=127)} FROM ({quantized(REPORT_VALUES, 127)}) GROUP BY tensor)""",
    "validate_finite": f"SELECT tensor, 'NonFiniteInput' AS code, min(idx) AS idx, count(*) AS n FROM (SELECT tensor, idx, {BAD} AS v FROM ({V})) WHERE isnan(v) OR isinf(v) GROUP BY tensor",
    "validate_ranges": f"SELECT tensor, 'QuantizedValueOutOfRange' AS code, min(idx) AS idx, count(*) AS n FROM ({quantized(V, 127)}) WHERE q NOT BETWEEN -8 AND 7 GROUP BY tensor",
    "preserved_identity_check": f"SELECT count(*) AS n, count(*) FILTER (v = v_hat) AS same FROM ({quantized(ordered('part', 'p_partkey', 'p_retailprice'), 127)})",
    "format_comparison": f"SELECT {metrics('format')} FROM ({FORMATS}) GROUP BY format",
    "nvfp4_unpack": f"SELECT tensor, idx, code::BIGINT AS code FROM ({fp4(V)})",
    "length_mismatch_check": f"""
      WITH s AS ({V}), r AS (
        SELECT tensor, idx FROM s WHERE NOT (tensor % 7 = 3 AND idx >= 60 OR tensor % 11 = 5) UNION ALL SELECT tensor, idx + 64 FROM s WHERE tensor % 13 = 4 AND idx < 2)
      SELECT coalesce(s.tensor, r.tensor) AS tensor, count(s.idx) AS source_len, count(r.idx) AS rebuilt_len FROM s FULL JOIN r ON s.tensor = r.tensor AND s.idx = r.idx
      GROUP BY 1 HAVING count(s.idx) < count(*) OR count(r.idx) < count(*)""",
    "reconstruction_check": f"SELECT {metrics('tensor', '', '1e4', '1e5', ('e4', 'e5'))} FROM ({q8(f'SELECT * FROM ({ORDERS}) WHERE idx < 1472')}) GROUP BY tensor",
    "int8_parts_check": f"{first('InvalidScale', 'IN (1, 2)')} UNION ALL {overflowing(quantized(V, 127), 3, 'abs(q::INTEGER) >= 2')} UNION ALL {first('QuantizedValueOutOfRange', '= 4', '9', '3')}",
    "int4_parts_check": " UNION ALL ".join([
        first("PackedLengthMismatch", "= 1", "32", "31"), first("PackedLengthMismatch", "= 2", "32", "33"), first("ScaleCountMismatch", "= 3", "3", "2"),
        first("InvalidScale", "= 4", "1", "2"), first("QuantizedValueOutOfRange", "= 5", "13", "2"), overflowing(quantized(V, 7, 24), 6, "abs(q::INTEGER) >= 2"),
    ]),
    "nvfp4_parts_check": " UNION ALL ".join([
        first("InvalidGlobalScale", "= 1"), first("PackedLengthMismatch", "= 2", "32", "30"), first("BlockScaleCountMismatch", "= 3", "4", "5"),
        first("InvalidBlockScale", "= 4", "1", "2"), first("ZeroScaleWithNonzeroValue", "= 5", "37"),
        overflowing(fp4(V), 6, f"abs(({FP4_VALUE})::DOUBLE) * 3e38::FLOAT::DOUBLE >= 3.4028235677973366e38"),
    ]),
    "q8_0_parts_check": " UNION ALL ".join([
        first("InvalidLength", "= 1", "63", "68"), first("InvalidDataLength", "= 2", "102", "68"), first("InvalidDataLength", "= 3", "68", "60"), first("InvalidScale", "= 4", "1"),
    ]),
    "parts_dequantize": f"""SELECT 'int4_24' AS format, tensor, idx, v_hat::DOUBLE AS v_hat FROM ({quantized(V, 7, 24)}) UNION ALL SELECT 'nvfp4', tensor, idx, v_hat FROM ({fp4_back(V)})
      UNION ALL SELECT 'q8_0', tensor, idx, v_hat FROM ({q8(V)})""",
    "given_scale_replay": f"""SELECT idx // 16384 AS chunk, count(*) AS n, sum(q)::BIGINT AS sum_q, {SATURATED.format(top=127)} FROM (
      SELECT idx, {level("v", "scale", 127)} AS q FROM ({M}), (SELECT {scale("max(abs(v))", 127)} AS scale FROM ({M}) WHERE idx % 10 = 0)) GROUP BY 1""",
    "safetensors_write_read": CONTAINER,
    "sharded_write_read": CONTAINER,
    "preserved_bytes_check": f"SELECT name AS tensor, byte_len AS n, true AS same FROM ({plan(CONTAINED)}) WHERE role = 'preserved'",
    "gguf_write_read": f"SELECT idx, v_hat::DOUBLE AS v_hat FROM ({Q8})",
    "manifest_json": f"""SELECT '{{"schema":"tensorloom.int8.manifest.v1","tensors":{{' || string_agg({RECORD}, ',' ORDER BY tensor) || '}}}}' AS manifest FROM ({decided()})""",
}
