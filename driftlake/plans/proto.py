"""Queries on protobuf definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftlake.operators import diff as D
from driftlake.operators import infer as I
from driftlake.operators import proto as P
from driftlake.operators import stats as S
from driftlake.plans.catalog import query
from driftlake.plans.inference import KEYS, KEYS_SQL, SCHEMA_SQL, TRAFFIC, nodes, samples
from driftlake.plans.views import base

# One definition per customer; types, names and values depend on the row.
_FILE = r"""concat('syntax = "proto3"; // v1
package shop.p', CAST(c_nationkey AS STRING), ';
import "google/protobuf/timestamp.proto";
/* block; comment { */
enum Level { option allow_alias = true; LOW = 0; ', upper(c_mktsegment), ' = 1; }
message Order', CAST(c_custkey % 3 AS STRING), ' {
  option deprecated = true;
  reserved 5, 6;
  ', CASE WHEN c_custkey % 2 = 0 THEN 'int64' ELSE 'string' END, ' order_id = 1;
  optional double amount = 2; // money
  repeated Line lines = 3;
  map<string, ', CASE c_custkey % 4 WHEN 0 THEN 'int32' WHEN 1 THEN 'Line' ELSE 'string' END, '> extra = 4;
  Level level = 7;
  google.protobuf.Timestamp at = 8 [deprecated=true];
  Duration took = 9;
  oneof pay { Card card = 10; bytes token = 11; }
  message Card { fixed32 no = 1; repeated bool flags = 2; }
  other.Unknown thing = 12;
}
message Line { sint32 q = 1; Order', CAST(c_custkey % 3 AS STRING), ' parent = 2; }
')"""


@query(
    "proto_nodes",
    """SELECT c_custkey, n.* FROM customer, LATERAL (VALUES
      ('', 'Order' || c_custkey % 3, 'order_id', CASE WHEN c_custkey % 2 = 0 THEN 'integer' ELSE 'string' END,
         CASE WHEN c_custkey % 2 = 0 THEN 'int64' END, '', NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'amount', 'number', 'double', '', NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'lines', 'array', NULL, '', NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'lines[]', 'object', NULL, '', 'Line', NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'extra', 'object', NULL, '', NULL,
         CASE c_custkey % 4 WHEN 0 THEN 'integer' WHEN 1 THEN 'object' ELSE 'string' END, NULL),
      ('', 'Order' || c_custkey % 3, 'level', 'string', NULL, 'LOW,' || upper(c_mktsegment), NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'at', 'string', 'date-time', '', NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'took', 'string', 'duration', '', NULL, NULL, NULL),
      ('', 'Order' || c_custkey % 3, 'card', 'object', NULL, '', 'Card', NULL, 'pay'),
      ('', 'Order' || c_custkey % 3, 'token', 'string', 'byte', '', NULL, NULL, 'pay'),
      ('', 'Order' || c_custkey % 3, 'thing', 'object', NULL, '', NULL, NULL, NULL),
      ('Order' || c_custkey % 3, 'Card', 'no', 'integer', 'int64', '', NULL, NULL, NULL),
      ('Order' || c_custkey % 3, 'Card', 'flags', 'array', NULL, '', NULL, NULL, NULL),
      ('Order' || c_custkey % 3, 'Card', 'flags[]', 'boolean', NULL, '', NULL, NULL, NULL),
      ('', 'Line', 'q', 'integer', 'int32', '', NULL, NULL, NULL),
      ('', 'Line', 'parent', 'object', NULL, '', 'Order' || c_custkey % 3, NULL, NULL)
    ) n("outer", message, path, type, format, enum_values, ref, value_type, oneof)""",
)
def proto_nodes(spark, sf_dir):
    corpus = base(spark, sf_dir, "customer").select("c_custkey", F.expr(_FILE.replace("\\", "\\\\")).alias("proto"))
    return P.proto_nodes(corpus, ["c_custkey"]).select(
        "c_custkey", "outer", "message", "path", "type", "format", F.array_join("enum_values", ",").alias("enum_values"),
        "ref", "value_type", "oneof",
    )


# The proto contract of the fixture traffic.
TRAFFIC_PROTO = """
message Order { string order_id = 1; double amount = 2; string currency = 3; repeated string items = 4;
  User user = 5; int32 zip = 6; string legacy_id = 7; }
message User { string name = 1; string email = 2; string phone = 3; }
"""


@query(
    "proto_drift",
    f"""SELECT {KEYS_SQL}, path,
          CASE WHEN i.path IS NULL THEN 'WARNING' WHEN b.path IS NULL AND i.required THEN 'BREAKING' WHEN b.path IS NULL THEN 'ADDITIVE'
               WHEN b.type = 'integer' AND i.type = 'number' THEN 'ADDITIVE' WHEN b.type <> i.type THEN 'BREAKING'
               WHEN i.nullable THEN 'WARNING' END AS severity
        FROM (SELECT {KEYS_SQL}, b.* FROM (SELECT DISTINCT {KEYS_SQL} FROM schema), (VALUES ('order_id', 'string'), ('amount', 'number'),
            ('currency', 'string'), ('items', 'array'), ('items[]', 'string'), ('user', 'object'), ('user.name', 'string'),
            ('user.email', 'string'), ('user.phone', 'string'), ('zip', 'integer'), ('legacy_id', 'string')) b(path, type)) b
        FULL JOIN schema i USING (service_id, endpoint, method, path)
        WHERE severity IS NOT NULL""",
    TRAFFIC, SCHEMA_SQL,
)
def proto_drift(spark, sf_dir):
    """Traffic of every key against its proto contract."""
    corpus = samples(spark, sf_dir).select(*KEYS).distinct().withColumn("proto", F.lit(TRAFFIC_PROTO))
    declared = P.expand_refs(P.proto_nodes(corpus, KEYS), KEYS, "Order")
    seen = I.schema_nodes(S.path_stats(nodes(spark, sf_dir, values=False)), with_root=True)
    return D.schema_diff(P.with_roots(declared, corpus, KEYS), seen, KEYS).select(*KEYS, "path", "severity")
