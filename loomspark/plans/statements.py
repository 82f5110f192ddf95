"""Queries on C statements and their tokens. The texts stand in for the rows of `part`; their expected forms are worked out by hand and stand beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import ctokens as X
from loomspark.functions.placeholders import placeholders

from .tables import read

# Statement, canonical form, renamed form.
TEXTS = [
    ("x = (int) y ;", "x=y", "v0=v1"),
    ("a=b; // c", "a=b", "v0=v1"),
    ("return ( (x + 1UL) );", "return x+1", "return v0+1"),
    ("if ( (p) != NULL )", "if(p!=0)", "if(v0!=0)"),
    ("foo ( (x) )", "foo(x)", "foo(v0)"),
    ("while(s -> len)", "while(s->len)", "while(v0->len)"),
    ("((a) + (b))", "a+b", "v0+v1"),
    ("(a) + (b)", "a+b", "v0+v1"),
    ("MAX = true", "MAX=1", "MAX=1"),
    ("x", "x", "v0"),
    ("", "", ""),
    ("/* only */", "", ""),
    (";;", "", ""),
    ("(unsigned char *) q . f", "q.f", "v0.f"),
    ("i ++", "i++", "v0++"),
    ("a.x == b.y", "a.x==b.y", "v0.x==v1.y"),
    ("a.y == b.x", "a.y==b.x", "v0.y==v1.x"),
    ("c.x == d.y", "c.x==d.y", "v0.x==v1.y"),
    ("a - -b", "a- -b", "v0- -v1"),
    ("a-- - b", "a-- -b", "v0-- -v1"),
    ("a + ++b", "a+ ++b", "v0+ ++v1"),
    ('s = "// no comment"', 's="// no comment"', 'v0="// no comment"'),
    ("s = \"a\\\"/*b*/\" ; /* c */", "s=\"a\\\"/*b*/\"", "v0=\"a\\\"/*b*/\""),
    ("c = ';';", "c=';'", "v0=';'"),
    ("c = '\\''", "c='\\''", "v0='\\''"),
    ("x = 0x1FUL", "x=0x1F", "v0=0x1F"),
    ("x = 10LL + 2u", "x=10+2", "v0=10+2"),
    ("x = 1.5f", "x=1.5f", "v0=1.5f"),
    ("x = 1e-5 - y", "x=1e-5-y", "v0=1e-5-v1"),
    ("(size_t)(unsigned long) n", "n", "v0"),
    ("(struct node *) p", "p", "v0"),
    ("sizeof(int) * n", "sizeof(int)*n", "sizeof(int)*v0"),
    ("sizeof (struct node)", "sizeof(struct node)", "sizeof(struct node)"),
    ("f(int)", "f(int)", "f(int)"),
    ("(int) - x", "-x", "-v0"),
    ("(n) - x", "n-x", "v0-v1"),
    ("-(x)", "-x", "-v0"),
    ("!((ok))", "!ok", "!v0"),
    ("a[(i)]", "a[i]", "v0[v1]"),
    ("(a + b) * c", "(a+b)*c", "(v0+v1)*v2"),
    ("(a + b) * (c)", "(a+b)*c", "(v0+v1)*v2"),
    ("((a + b))", "a+b", "v0+v1"),
    ("(((x)))", "x", "v0"),
    ("f((a, b))", "f((a,b))", "f((v0,v1))"),
    ("f()", "f()", "f()"),
    ("(f())", "f()", "f()"),
    ("((f)(x))", "f(x)", "f(v0)"),
    ("p->next = p", "p->next=p", "v0->next=v0"),
    ("next = p->next", "next=p->next", "v0=v1->next"),
    ("b = a; a = b", "b=a;a=b", "v0=v1;v1=v0"),
    ("return", "return", "return"),
    ("return (int) x", "return x", "return v0"),
    ("return(x)", "return x", "return v0"),
    ("return -1", "return-1", "return-1"),
    ("unsigned int n = 0", "unsigned int n=0", "unsigned int v0=0"),
    ("if (((a) && (b)))", "if(a&&b)", "if(v0&&v1)"),
    ("if (a) b = c", "if(a)b=c", "if(v0)v1=v2"),
    ("while ((x = f(y)) != EXIT_SUCCESS)", "while((x=f(y))!=0)", "while((v0=f(v1))!=0)"),
    ("goto out", "goto out", "goto v0"),
    ("x = y ? (z) : FALSE", "x=y?z:0", "v0=v1?v2:0"),
    ("q.NULL = NULL", "q.NULL=0", "v0.NULL=0"),
    ("a <<= b", "a<<=b", "v0<<=v1"),
    ("(a", "(a", "(v0"),
    ("a) + (b", "a)+(b", "v0)+(v1"),
    ("é = a", "é=a", "é=v0"),
    ("x /* a */ = /* b\n */ y", "x=y", "v0=v1"),
]
# Statements of a function, and the same with names replaced.
RENAMED = [
    ("x = 0x1F + 10UL;", "var_0 = 0x1F + 10UL;"),
    ("y = 1e5f + x;", "var_0 = 1e5f + var_1;"),
    ("foo(a, foo);", "func_0(var_0, var_1);"),
    ("if (NULL == p) return bar (p);", "if (NULL == var_0) return func_0 (var_0);"),
    ("naïve = a1;", "naïve = var_0;"),
    ("int n_1 = n_1 + n1;", "int var_0 = var_0 + var_1;"),
    ("3x = _y;", "3x = var_0;"),
    ("", ""),
]


def _pick(texts: list[str], key: Column) -> Column:
    return F.get(F.array(*map(F.lit, texts)), (key % len(texts)).cast("int"))


def canonical_statements(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "part").select("p_partkey", _pick([t for t, _, _ in TEXTS], F.col("p_partkey")).alias("text"))
    return X.canonical_statements(rows, ["p_partkey"], "text").select("p_partkey", "canonical", "alpha")


def symbolic_proofs(spark: SparkSession, d: str) -> DataFrame:
    texts = [t for t, _, _ in TEXTS]
    rows = read(spark, d, "part").select("p_partkey", _pick(texts, F.col("p_partkey")).alias("a"), _pick(texts, F.col("p_partkey") + F.col("p_size") % 11).alias("b"))
    return X.symbolic_proofs(rows, ["p_partkey"], "a", "b", True)


def identifier_placeholders(spark: SparkSession, d: str) -> DataFrame:
    """Functions of one statement, as each part has, and its text again in front of it."""
    text = _pick([t for t, _ in RENAMED], F.col("p_partkey"))
    return read(spark, d, "part").select("p_partkey", F.array_join(placeholders(F.array(text, text)), " | ").alias("renamed"))


QUERIES = {f.__name__: f for f in (canonical_statements, symbolic_proofs, identifier_placeholders)}


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join([str(k), *("'" + x.replace("'", "''") + "'" for x in r)]) + ")" for k, r in enumerate(rows))


_C = _values([r[1:] for r in TEXTS])
#: Forms without an operator or `return`: a name, a call without arguments has parentheses, a jump.
_PLAIN = "('', 'x', 'n', 'p', 'goto out')"
ORACLES = {
    "canonical_statements": f"WITH t(k, canonical, alpha) AS (VALUES {_C}) SELECT p_partkey, canonical, alpha FROM part JOIN t ON k = p_partkey % {len(TEXTS)}",
    "symbolic_proofs": f"""WITH t(k, c, a) AS (VALUES {_C})
        SELECT p_partkey, CASE WHEN x.c <> '' AND x.c = y.c THEN 'canonical' WHEN x.a = y.a AND x.c NOT IN {_PLAIN} AND y.c NOT IN {_PLAIN} THEN 'alpha' ELSE 'none' END AS proof
        FROM part JOIN t x ON x.k = p_partkey % {len(TEXTS)} JOIN t y ON y.k = (p_partkey + p_size % 11) % {len(TEXTS)}""",
    "identifier_placeholders": f"WITH t(k, r) AS (VALUES {_values([r[1:] for r in RENAMED])}) SELECT p_partkey, r || ' | ' || r AS renamed FROM part JOIN t ON k = p_partkey % {len(RENAMED)}",
}
