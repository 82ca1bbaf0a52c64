"""Which dialect a script is in, and its constructs that Spark's parser rejects put into words that it takes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.lineage.lexer import NUMBER, QUOTED, STRING, WORD, Token, tokenize

#: Dialect, points and pattern of each marker.
MARKERS = (
    ("hive", 10, r"(?i)INSERT\s+OVERWRITE\s+TABLE"),
    ("hive", 10, r"(?i)SET\s+odps\."),
    ("hive", 5, r"(?i)PARTITION\s*\("),
    ("hive", 5, r"(?i)TBLPROPERTIES|STORED\s+AS\s+(ORC|PARQUET|TEXTFILE|AVRO)"),
    ("hive", 5, r"(?i)LATERAL\s+VIEW\s+EXPLODE"),
    ("oracle", 3, r"(?i)DECODE\s*\("),
    ("oracle", 3, r"(?i)NVL\s*\("),
    ("oracle", 10, r"(?i)CONNECT\s+BY"),
    ("oracle", 10, r"(?i)DBMS_|UTL_"),
    ("oracle", 5, r"(?i)ROWNUM\b"),
    ("oracle", 10, r"(?i)FROM\s+DUAL\b"),
    ("postgres", 5, r"(?i)ILIKE\b"),
    ("postgres", 5, r"::"),
    ("postgres", 3, r"(?i)RETURNING\b"),
    ("bigquery", 10, r"(?i)`[a-z]+\.[a-z]+\.[a-z]+`"),
    ("bigquery", 5, r"(?i)STRUCT\s*<"),
    ("bigquery", 3, r"(?i)ARRAY\s*<"),
    ("tsql", 5, r"(?i)\bTOP\s+\d+"),
    ("tsql", 3, r"(?i)\[[a-z_][a-z0-9_ ]*\]\.\[?[a-z_]"),
    ("tsql", 10, r"(?i)WITH\s*\(\s*NOLOCK\s*\)"),
    ("snowflake", 10, r"(?i)QUALIFY\b"),
    ("snowflake", 5, r"(?i)COPY\s+INTO"),
    ("mysql", 2, r"(?i)LIMIT\s+\d+(\s+OFFSET\s+\d+)?\s*;?\s*(\n|$)"),
    ("mysql", 10, r"(?i)ENGINE\s*="),
    ("mysql", 10, r"(?i)AUTO_INCREMENT"),
)


def dialect_of(text: Column) -> Column:
    """The dialect with the most points, as one expression; half of oracle's points go to hive where hive has any; mysql if none has."""
    points = {}
    for name, weight, pattern in MARKERS:
        hit = text.rlike(pattern) if pattern != "::" else text.contains("::") & ~text.contains("::=")
        points[name] = points.get(name, F.lit(0.0)) + F.when(hit, float(weight)).otherwise(0.0)
    hive = points["hive"] > 0
    points["hive"] = points["hive"] + F.when(hive, points["oracle"] * 0.5).otherwise(0.0)
    points["oracle"] = F.when(hive, 0.0).otherwise(points["oracle"])
    # ties: the earlier in the list of markers
    ranked = F.array_max(F.array(*(F.struct(p.alias("p"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, p) in enumerate(points.items()))))
    return F.when(ranked["p"] > 0, ranked["name"]).otherwise("mysql")


def into_target(text: str) -> str | None:
    """The table that a SELECT ... INTO names."""
    m = re.search(r"\bINTO\s+([\w.]+)\s+FROM\b", text, re.IGNORECASE)
    return m[1] if m else None


def parsed(spark, text: str, dialect: str) -> tuple[str, str] | None:
    """(dialect, statement) of the first that Spark parses: the text as it is, then rewritten; named after the dialect found, then hive, then mysql as the ones it may fall back on. None if none parses."""
    parser = spark._jsparkSession.sessionState().sqlParser()
    for name in dict.fromkeys((dialect, "hive", "mysql")):
        for statement in (text, rewrite(text)) if name == dialect else (quoted(rewrite(text), name),):
            try:
                parser.parsePlan(statement)
                return name, statement
            except Exception:  # the parser's own errors, of several classes of the JVM
                continue
    return None


def quoted(text: str, dialect: str) -> str:
    """Names quoted in another way in back ticks: brackets, and double quotes where these are no strings (hive and mysql take them for strings)."""
    tokens, out, at = tokenize(text), [], 0
    for t in tokens:
        out.append(text[at : t.start])
        named = t.kind == QUOTED and (t.text[0] == "[" or t.text[0] == '"' and dialect == "hive")
        out.append(f"`{t.name}`" if named else t.text)
        at = t.end
    return "".join(out) + text[at:]


def _depths(tokens: list[Token]) -> list[int]:
    out, depth = [], 0
    for t in tokens:
        depth -= t.text == ")"
        out.append(depth)
        depth += t.text == "("
    return out


def rewrite(text: str) -> str:
    """One query of another dialect in Spark's: TOP, FETCH FIRST, NOLOCK, SELECT INTO, QUALIFY, ``->>``, CONNECT BY LEVEL."""
    hierarchy = re.search(r"SELECT\s+(.*?)\s+FROM\s+DUAL\s+CONNECT\s+BY\s+LEVEL\s*<=\s*(\d+)", text, re.IGNORECASE | re.DOTALL)
    if hierarchy:
        path = re.search(r"SYS_CONNECT_BY_PATH\s*\(\s*LEVEL\s*,\s*('[^']*')\s*\)", text, re.IGNORECASE)
        sign = path[1] if path else "'/'"
        items = hierarchy[1].replace(path[0], "_path") if path else hierarchy[1]
        items = re.sub(r"\bLEVEL\b(?!\s*,?\s*FROM)", lambda m: m[0].lower(), items)
        return f"WITH RECURSIVE _levels AS (SELECT 1 AS level, CAST('1' AS STRING) AS _path UNION ALL SELECT level + 1, concat(_path, {sign}, CAST(level + 1 AS STRING)) FROM _levels WHERE level < {hierarchy[2]}) SELECT {items} FROM _levels"
    tokens = tokenize(text)
    depths = _depths(tokens)
    drop: set[int] = set()
    limit = ""
    for i, t in enumerate(tokens):
        nxt = [x.upper for x in tokens[i + 1 : i + 6]]
        if t.upper == "TOP" and tokens[i - 1].upper in ("SELECT", "DISTINCT") and depths[i] == 0 and tokens[i + 1].kind == NUMBER:
            limit = f" LIMIT {tokens[i + 1].text}"
            drop |= {i, i + 1}
        elif t.upper == "FETCH" and nxt[:1] in (["FIRST"], ["NEXT"]) and depths[i] == 0:
            limit = f" LIMIT {tokens[i + 2].text}"
            drop |= set(range(i, min(len(tokens), i + 5)))
        elif t.upper == "WITH" and nxt[:3] == ["(", "NOLOCK", ")"]:
            drop |= set(range(i, i + 4))
        elif t.upper == "INTO" and depths[i] == 0 and tokens[0].upper == "SELECT" and tokens[i + 1].kind in (WORD, QUOTED):
            drop |= {i, i + 1}
            j = i + 2
            while j + 1 < len(tokens) and tokens[j].text == ".":
                drop |= {j, j + 1}
                j += 2
        elif t.text == "->>" and tokens[i + 1].kind == STRING:
            # a path of names before the sign becomes the document
            j = i - 1
            while j >= 2 and tokens[j - 1].text == ".":
                j -= 2
            document = "".join(x.text for x in tokens[j:i])
            key = tokens[i + 1].text.strip("'")
            key = key if key.startswith("$") else f"$.{key}"
            return rewrite(f"{text[: tokens[j].start]}get_json_object({document}, '{key}'){text[tokens[i + 1].end :]}")
    kept = [t for i, t in enumerate(tokens) if i not in drop]
    out, at = [], 0
    for t in tokens:
        out.append(text[at : t.start])
        if t in kept:
            out.append(t.text)
        at = t.end
    result = ("".join(out).rstrip().rstrip(";") + limit).strip()
    q = next((i for i, t in enumerate(tokens) if t.upper == "QUALIFY" and depths[i] == 0), None)
    if q is not None:
        end = next((i for i in range(q + 1, len(tokens)) if depths[i] == 0 and tokens[i].upper in ("ORDER", "LIMIT")), len(tokens))
        condition = text[tokens[q + 1].start : tokens[end - 1].end]
        rest = text[tokens[end].start :] if end < len(tokens) else ""
        head = text[: tokens[q].start]
        window = re.match(r"(.*\))\s*(<=|>=|=|<|>)\s*(\S+)\s*$", condition, re.DOTALL)
        value, test = (window[1], f"{window[2]} {window[3]}") if window else (condition, "")
        first = tokens[1].start if tokens[0].upper == "SELECT" else 0
        return f"SELECT * EXCEPT (_q) FROM (SELECT {value} AS _q, {head[first:]}) WHERE _q {test} {rest}".strip()
    return result
