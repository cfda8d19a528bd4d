from driftlake.operators.proto import expand_refs, proto_nodes


def nodes(spark, text):
    return proto_nodes(spark.createDataFrame([(1, text)], "k int, proto string"), ["k"])


def test_literals_comments_and_options(spark):
    text = """
    syntax = "proto3"; option go_package = "http://x/*y"; // "no { string
    message A {
      /* "a } comment" */ string s = 1 [(v.rules).string = {min_len: 1, in: ["a;b", '}']}];
      int32 n = 2 [deprecated = true]; string w = 3 [(http) = {get: "shelves/*"}];
      repeated B b = 4;
    }
    message B { string z = 1; /* end */ }"""
    got = {(r.message, r.path, r.type) for r in nodes(spark, text).collect()}
    assert got == {("A", "s", "string"), ("A", "n", "integer"), ("A", "w", "string"), ("A", "b", "array"), ("A", "b[]", "object"), ("B", "z", "string")}


def test_enums_of_the_nearest_scope(spark):
    text = """enum E { TOP = 0; }
    message A { enum E { IN_A = 0; } E e = 1; message C { E e = 1; } B.E q = 2; }
    message B { enum E { IN_B = 0; OTHER = 1; } E e = 1; }
    message D { E e = 1; }"""
    got = {(r.outer, r.message, r.path): r.enum_values for r in nodes(spark, text).collect()}
    assert got == {("", "A", "e"): ["IN_A"], ("A", "C", "e"): ["IN_A"], ("", "A", "q"): ["IN_B", "OTHER"], ("", "B", "e"): ["IN_B", "OTHER"], ("", "D", "e"): ["TOP"]}


def test_references_of_any_depth(spark):
    text = "".join(f"message M{i} {{ M{i + 1} next = 1; M0 first = 2; }}" for i in range(7)) + "message M7 { string leaf = 1; M3 again = 2; }"
    paths = {r.path for r in expand_refs(nodes(spark, text), ["k"], "M0").collect()}
    assert ".".join(["next"] * 7 + ["leaf"]) in paths and ".".join(["next"] * 7 + ["again"]) in paths
    assert not any(p.startswith("first.") or "again." in p for p in paths)
