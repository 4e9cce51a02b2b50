"""RDF: parsers for schema-sized files on the driver, N-Triples at scale, and graphs from triples.

A term is a string: an IRI as it is, a blank node as ``_:name``, a literal in N-Triples form. Two
literals are one node only if text, datatype and language are the same.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import XSD, Graph

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
TYPE = RDF + "type"
Triple = tuple[str, str, str]

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<long>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\")
    |(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<dt>\^\^)
    |(?P<mark>[;,.\[\]()](?![0-9]))
    |(?P<number>[+-]?(?:[0-9]+\.[0-9]+|\.[0-9]+|[0-9]+)(?:[eE][+-]?[0-9]+)?)
    |(?P<bnode>_:[\w.-]*\w)
    |(?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%:-]+(?:\.[\w%:-]+)*)?|[A-Za-z]+)
    """,
    re.X,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def is_literal(term: str) -> bool:
    return term.startswith('"')


def literal(text: str, datatype: str | None = None, lang: str | None = None) -> str:
    text = text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r")
    return f'"{text}"' + (f"^^<{datatype}>" if datatype else f"@{lang}" if lang else "")


def literal_parts(term: str) -> tuple[str, str | None]:
    """Text and datatype of a literal."""
    m = re.fullmatch(r'"(.*)"(?:\^\^<(.*)>|@.*)?', term, re.S)
    return _unescape(m[1]), m[2]


def _unescape(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


class _Turtle:
    """Recursive descent over Turtle: prefixes, ``a``, ``;`` and ``,`` lists, collections, blank nodes, literals."""

    def __init__(self, text: str, scope: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise ValueError(f"Turtle: unexpected {text[at : at + 20]!r}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.count, self.scope = 0, 0, scope
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.out: list[Triple] = []

    def parse(self) -> list[Triple]:
        while self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            word = value.lower().lstrip("@")
            if kind in ("lang", "name") and word in ("prefix", "base"):
                self.at += 1
                if word == "prefix":
                    name = self._next()[1]
                    self.prefixes[name[:-1]] = self._iri(self._next()[1])
                else:
                    self.base = self._next()[1][1:-1]
                if self._peek() == ".":
                    self.at += 1
                continue
            subject = self._term()
            if self._peek() != ".":
                self._predicates(subject)
            self._expect(".")
        return self.out

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else ""

    def _next(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def _expect(self, mark: str):
        if self._peek() != mark:
            raise ValueError(f"Turtle: expected {mark!r}, found {self._peek()!r}")
        self.at += 1

    def _iri(self, token: str) -> str:
        inner = token[1:-1]
        return inner if ":" in inner else self.base + inner

    def _fresh(self) -> str:
        self.count += 1
        return f"_:{self.scope}b{self.count}"

    def _predicates(self, subject: str):
        while True:
            kind, value = self.tokens[self.at]
            predicate = TYPE if (kind, value) == ("name", "a") else None
            if predicate:
                self.at += 1
            else:
                predicate = self._term()
            while True:
                self.out.append((subject, predicate, self._term()))
                if self._peek() != ",":
                    break
                self.at += 1
            while self._peek() == ";":
                self.at += 1
            if self._peek() in (".", "]", ""):
                return

    def _term(self) -> str:
        kind, value = self._next()
        if kind == "iri":
            return self._iri(value)
        if kind == "bnode":
            return f"_:{self.scope}{value[2:]}"
        if kind in ("text", "long"):
            text = _unescape(value[3:-3] if kind == "long" else value[1:-1])
            if self._peek() == "^^":
                self.at += 1
                return literal(text, self._term())
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "lang":
                return literal(text, lang=self._next()[1][1:])
            return literal(text)
        if kind == "number":
            return literal(value, XSD + ("double" if "e" in value.lower() else "decimal" if "." in value else "integer"))
        if value == "[":
            node = self._fresh()
            if self._peek() != "]":
                self._predicates(node)
            self._expect("]")
            return node
        if value == "(":
            items = []
            while self._peek() != ")":
                items.append(self._term())
            self.at += 1
            return _collection(items, self._fresh, self.out)
        if kind == "name":
            if value in ("true", "false"):
                return literal(value, XSD + "boolean")
            prefix, _, local = value.partition(":")
            if prefix in self.prefixes:
                return self.prefixes[prefix] + local
        raise ValueError(f"Turtle: unexpected {value!r}")


def _collection(items: list[str], fresh, out: list[Triple]) -> str:
    head = RDF + "nil"
    for item in reversed(items):
        cell = fresh()
        out += [(cell, RDF + "first", item), (cell, RDF + "rest", head)]
        head = cell
    return head


def parse_turtle(text: str, scope: str = "") -> list[Triple]:
    """The distinct triples of a Turtle or N-Triples text; ``scope`` keeps blank nodes of files apart."""
    return list(dict.fromkeys(_Turtle(text, scope).parse()))


def parse_rdfxml(text: str, scope: str = "") -> list[Triple]:
    """The distinct triples of an RDF/XML text (typed nodes, resources, literals, collections)."""
    out: list[Triple] = []
    count = 0
    root = ET.fromstring(text)
    base = root.get("{http://www.w3.org/XML/1998/namespace}base", "")
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def fresh():
        nonlocal count
        count += 1
        return f"_:{scope}x{count}"

    def resolve(iri):
        return iri if ":" in iri else base + iri

    def node(e) -> str:
        q = lambda a: e.get("{%s}%s" % (RDF, a))
        subject = resolve(q("about")) if q("about") is not None else resolve("#" + q("ID")) if q("ID") else f"_:{scope}{q('nodeID')}" if q("nodeID") else fresh()
        if name(e.tag) != RDF + "Description":
            out.append((subject, TYPE, name(e.tag)))
        for a, v in e.attrib.items():
            if a[0] == "{" and not name(a).startswith(RDF) and "XML/1998" not in a:
                out.append((subject, name(a), literal(v)))
        for p in e:
            out.append((subject, name(p.tag), value(p)))
        return subject

    def value(p) -> str:
        q = lambda a: p.get("{%s}%s" % (RDF, a))
        if q("resource") is not None:
            return resolve(q("resource"))
        if q("nodeID"):
            return f"_:{scope}{q('nodeID')}"
        if q("parseType") == "Collection":
            return _collection([node(x) for x in p], fresh, out)
        if q("parseType") == "Resource":
            subject = fresh()
            out.extend((subject, name(x.tag), value(x)) for x in p)
            return subject
        if len(p):
            return node(p[0])
        return literal(p.text or "", q("datatype"), p.get("{http://www.w3.org/XML/1998/namespace}lang"))

    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return list(dict.fromkeys(out))


def load_schema(paths: list[str]) -> list[Triple]:
    """Triples of schema files, by their extension."""
    out: list[Triple] = []
    for k, path in enumerate(paths):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        xml = path.endswith((".rdf", ".xml")) or path.endswith(".owl") and text.lstrip().startswith("<")
        out += (parse_rdfxml if xml else parse_turtle)(text, f"f{k}")
    return list(dict.fromkeys(out))


_IRI = r'<[^\x00-\x20<>"{}|^`]*>'
_BLANK = r'_:[^\s<>"]*[^\s<>".]'
_LITERAL = rf'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\^\^{_IRI}|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?'
_LINE = rf"^[ \t]*({_IRI}|{_BLANK})[ \t]*({_IRI})[ \t]*({_IRI}|{_BLANK}|{_LITERAL})[ \t]*\.[ \t]*(?:#.*)?$"
_NO_TRIPLE = r"^[ \t]*(?:#.*)?$"


def _unescaped(c: Column, text: bool) -> Column:
    """A term's escapes as the characters they stand for; in a literal, those that ``literal`` sets stay or are set."""
    kept = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r"} if text else {}
    short = {"t": "\t", "b": "\b", "f": "\f", "'": "'"} | ({} if text else {"n": "\n", "r": "\r", '"': '"', "\\": "\\"})

    def one(x: Column) -> Column:
        code = F.unhex(F.lpad(F.substring(x, 3, 8), 8, "0"))
        char = F.decode(code, "UTF-32")
        for raw, escaped in kept.items():
            char = F.when(char == raw, F.lit(escaped)).otherwise(char)
        out = F.when(F.length(x) > 2, char)
        for letter, raw in short.items():
            out = out.when(x == "\\" + letter, F.lit(raw))
        return F.when(x.startswith("\\"), out.otherwise(x)).otherwise(x)

    pieces = F.regexp_extract_all(c, F.lit(r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"), F.lit(0))
    return F.when(F.contains(c, F.lit("\\")), F.array_join(F.transform(pieces, one), "")).otherwise(c)


def malformed_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) that are neither a triple nor empty nor a comment."""
    return spark.read.text(path).where(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(_NO_TRIPLE))


def read_ntriples(spark: SparkSession, path: str, *, malformed: str = "raise") -> DataFrame:
    """triples (s, p, o) of N-Triples files: one line a triple, parsed where the lines are.

    Escapes are resolved, so that a term equals the one that the other parsers give. A line that is no
    triple fails the read, or is left out with ``malformed="skip"``; ``malformed_ntriples`` lists them.
    """
    if malformed not in ("raise", "skip"):
        raise ValueError(f"malformed: {malformed}")
    lines = spark.read.text(path)
    if malformed == "skip":
        lines = lines.where(F.col("value").rlike(_LINE))
    else:
        lines = lines.where(~F.col("value").rlike(_NO_TRIPLE))
        bad = F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200)))
        lines = lines.select(F.when(F.col("value").rlike(_LINE), F.col("value")).otherwise(bad.cast("string")).alias("value"))
    part = lambda k: F.regexp_extract("value", _LINE, k)

    def term(c: Column) -> Column:
        iri = _unescaped(F.regexp_replace(c, "^<(.*)>$", "$1"), False)
        return F.when(c.startswith('"'), _unescaped(c, True)).when(c.startswith("<"), iri).otherwise(c)

    return lines.select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o")).select(*(term(F.col(c)).alias(c) for c in "spo")).distinct()


#: Characters that an IRI can't hold, written by their code.
_NOT_IN_IRI = ("\\", " ", "<", ">", '"', "{", "}", "|", "^", "`", "\t", "\n", "\r")


def _written(c: str) -> Column:
    iri = F.col(c)
    for x in _NOT_IN_IRI:
        iri = F.replace(iri, F.lit(x), F.lit(f"\\u{ord(x):04X}"))
    return F.when(F.col(c).startswith('"') | F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes triples (s, p, o) as N-Triples; what an IRI can't hold is escaped, and read back as it was."""
    triples.select(F.concat_ws(" ", _written("s"), _written("p"), _written("o"), F.lit(".")).alias("value")).write.mode(mode).text(path)


def turtle_text(triples: list[Triple], prefixes: dict[str, str] | None = None) -> str:
    """Turtle of schema-sized triples: prefixes {name: IRI}, a subject's statements together."""
    prefixes = dict(prefixes or {})

    def term(x: str) -> str:
        if x.startswith('"'):
            head, mark, datatype = x.rpartition('"^^<')
            return f'{head}"^^{term(datatype[:-1])}' if mark else x
        if x.startswith("_:"):
            return x
        for name, iri in prefixes.items():
            if x.startswith(iri) and re.fullmatch(r"[A-Za-z0-9_][\w-]*", x[len(iri) :]):
                return f"{name}:{x[len(iri):]}"
        return f"<{x}>"

    by: dict[str, dict[str, list[str]]] = {}
    for s, p, o in triples:
        by.setdefault(s, {}).setdefault(p, []).append(o)
    out = [f"@prefix {name}: <{iri}> ." for name, iri in prefixes.items()]
    for s, said in by.items():
        out.append(f"{term(s)} " + " ;\n    ".join(f"{'a' if p == TYPE else term(p)} " + ", ".join(map(term, objects)) for p, objects in said.items()) + " .")
    return "\n".join(out) + "\n"


def import_individuals(data: DataFrame, schema: list[Triple]) -> DataFrame:
    """Data triples with those of the schema's named individuals that they mention, and of all these mention.

    Individuals that the schema makes the same share what it says of each. Only which of the schema's
    individuals occur in the data reaches the driver.
    """
    own = {s for s, p, o in schema if p == TYPE and o == OWL + "NamedIndividual"}
    if not own:
        return data
    group = {x: {x} for x in own}
    for s, p, o in schema:
        if p == OWL + "sameAs" and s in own and o in own and group[s] is not group[o]:
            group[s] |= group[o]
            for x in group[s]:
                group[x] = group[s]
    said: dict[str, list[tuple[str, str]]] = {}
    for s, p, o in schema:
        if s in own:
            said.setdefault(s, []).append((p, o))
    spark = data.sparkSession
    import pyarrow as pa

    names = spark.createDataFrame(pa.table({"id": pa.array(sorted(own), pa.string())}))
    ends = data.select(F.col("s").alias("id")).unionByName(data.select(F.col("o").alias("id")))
    todo = [r.id for r in ends.join(names, "id", "left_semi").distinct().collect()]
    done: set[str] = set()
    out: list[Triple] = []
    while todo:
        x = todo.pop()
        if x not in done:
            done.add(x)
            for p, o in dict.fromkeys(y for m in sorted(group[x]) for y in said.get(m, ())):
                out.append((x, p, o))
                todo += [o] if o in own else []
    return data.select("s", "p", "o").unionByName(triples_frame(spark, out)).distinct()


def graph_triples(graph: Graph, threshold: float = 0.5) -> DataFrame:
    """A graph as triples: its edges, and types of a weight over the threshold."""
    typed = graph.types.where(F.col("w") > threshold).select(F.col("id").cast("string").alias("s"), F.lit(TYPE).alias("p"), F.col("cls").alias("o"))
    return graph.edges.select(F.col("src").cast("string").alias("s"), "p", F.col("dst").cast("string").alias("o")).unionByName(typed)


@dataclass(frozen=True)
class Facts:
    """What triples say: a graph, and the facts that aren't edges or types."""

    graph: Graph
    same: DataFrame  # a, b
    different: DataFrame  # a, b
    denied_edges: DataFrame  # p, src, dst
    denied_types: DataFrame  # id, cls


#: Classes that describe the schema, not individuals.
_META = [OWL + x for x in ("Class", "Restriction", "NamedIndividual", "Ontology", "ObjectProperty", "DatatypeProperty", "NegativePropertyAssertion", "AllDifferent", "AnnotationProperty", "FunctionalProperty", "TransitiveProperty", "ReflexiveProperty")]
_META += [RDFS + "Class", RDFS + "Datatype", RDF + "Property"]


def facts_from_triples(triples: DataFrame, *, literals: bool = True, type_edges: bool = False) -> Facts:
    """Facts from triples (s, p, o): literals become nodes or are left out, as asked."""
    t = triples.select("s", "p", "o").distinct()
    said = lambda name: t.where(F.col("p") == OWL + name)
    denials = said("assertionProperty").select("s", F.col("o").alias("p"))
    source = said("sourceIndividual").select("s", F.col("o").alias("src"))
    target = said("targetIndividual").unionByName(said("targetValue")).select("s", F.col("o").alias("dst"))
    denied = denials.join(source, "s").join(target, "s").select("p", "src", "dst").distinct()
    complement = said("complementOf").select(F.col("s").alias("o"), F.col("o").alias("cls"))
    denied_types = t.where(F.col("p") == TYPE).join(complement, "o").select(F.col("s").alias("id"), "cls")
    denied_types = denied_types.unionByName(denied.where(F.col("p") == TYPE).select(F.col("src").alias("id"), F.col("dst").alias("cls"))).distinct()
    pairs = lambda name: said(name).select(F.col("s").alias("a"), F.col("o").alias("b"))

    vocabulary = F.col("p").startswith(OWL) | F.col("p").startswith(RDFS) | F.col("p").startswith(RDF)
    edges = t.where(~vocabulary | ((F.col("p") == TYPE) if type_edges else F.lit(False)))
    if not literals:
        edges = edges.where(~F.col("o").startswith('"'))
    edges = edges.select("p", F.col("s").alias("src"), F.col("o").alias("dst"))
    types = t.where((F.col("p") == TYPE) & ~F.col("o").isin(_META) & ~F.col("o").startswith("_:")).select(F.col("s").alias("id"), F.col("o").alias("cls"))
    individuals = t.where((F.col("p") == TYPE) & (F.col("o") == OWL + "NamedIndividual")).select(F.col("s").alias("id"))
    same, different = pairs("sameAs"), pairs("differentFrom")
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).unionByName(types.select("id")).unionByName(individuals)
    for p in (same, different):
        ids = ids.unionByName(p.select(F.col("a").alias("id"))).unionByName(p.select(F.col("b").alias("id")))
    ids = ids.unionByName(denied_types.select("id")).unionByName(denied.select(F.col("src").alias("id"))).distinct()
    is_text = F.col("id").startswith('"')
    datatype = F.when(is_text, F.coalesce(F.nullif(F.regexp_extract("id", r'"\^\^<([^>]*)>$', 1), F.lit("")), F.lit(XSD + "string")))
    number = F.when(is_text, F.expr(r"try_cast(regexp_extract(id, '^\"([^\"]*)\"', 1) AS double)"))
    nodes = ids.select("id", datatype.alias("dt"), number.alias("num"))
    return Facts(Graph(nodes, edges, types.withColumn("w", F.lit(1.0))), same, different, denied.where(F.col("p") != TYPE), denied_types)


def load_facts(spark: SparkSession, path: str, **options) -> Facts:
    """Facts of N-Triples files, parsed once: triples, nodes, edges and types are written to the shared folder."""
    facts = facts_from_triples(materialize(read_ntriples(spark, path), "triples"), **options)
    g = facts.graph
    graph = replace(g, nodes=materialize(g.nodes, "nodes"), edges=materialize(g.edges, "edges"), types=materialize(g.types, "types"))
    return replace(facts, graph=graph)


def triples_frame(spark: SparkSession, triples: list[Triple]) -> DataFrame:
    """Driver-side triples as a table."""
    import pyarrow as pa

    columns = list(zip(*triples)) or [(), (), ()]
    return spark.createDataFrame(pa.table([pa.array(c, pa.string()) for c in columns], names=["s", "p", "o"]))
