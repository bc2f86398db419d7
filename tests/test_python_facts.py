"""Context of candidates in Python files."""

import random
import textwrap

import pytest

from keysieve.operators import python_facts as P
from keysieve.operators.context import add_context
from keysieve.operators.recover import recover_candidates

KEY = "Lt3whkyVHH7iAtP28iNIq7hVNlK638vR"


def contexts(files, source, path="src/a.py"):
    rows = add_context(recover_candidates(files((path, textwrap.dedent(source).replace("KEY", KEY)))))
    return rows.orderBy("sig_ord", "start_index").collect()


@pytest.mark.parametrize(
    "line, variable, parent",
    [
        ('a = "KEY"', "a", "Assign"),
        ('a.b = "KEY"', "b", "Assign"),
        ('a["x"] = "KEY"', "subscript", "Assign"),
        ('(x, y) = z = "KEY"', "z", "Assign"),
        ('a: str = "KEY"', "a", "AnnAssign"),
        ('f(token="KEY")', "token", "keyword"),
        ('d = {"k": "KEY"}', None, "Dict"),
        ('f"KEY{x}"', None, "JoinedStr"),
        ('a = ["KEY"]', None, "List"),
    ],
)
def test_binding_is_the_direct_parent(files, line, variable, parent):
    (row,) = contexts(files, line)
    assert (row["variable_name"], row["parent_node_type"], row["ast_node_type"]) == (variable, parent, "Constant")


def test_not_in_a_string(files):
    (row,) = contexts(files, "# KEY\nx = 1\n")
    assert row["ast_node_type"] == "Module"
    assert row["context_evidence"] == ["Candidate was not attached to a Python string literal."]
    assert row["usage_context"] == f"# {KEY}"


def test_broken_source(files):
    (row,) = contexts(files, 'def f(:\nx = "KEY"\n')
    assert row["parse_error"] == "SyntaxError: invalid syntax"
    assert row["ast_node_type"] is None and row["variable_name"] is None and row["context_evidence"] == []
    assert row["usage_context"] == f'x = "{KEY}"'


def test_deep_nesting_does_not_stop_the_scan(files):
    (row,) = contexts(files, "x = " + "(" * 5000 + '"KEY"' + ")" * 5000)
    assert row["parse_error"]


def test_uses_count_from_the_line_on_in_parse_order(files):
    source = '''
        early(TOKEN)
        TOKEN = "KEY"
        def late():
            outer(inner(TOKEN), "https://a.acme.io")
        first(x=[TOKEN])
        other(TOKENS)
        a.b().c(TOKEN)
        (lambda: 0)(TOKEN)
    '''
    (row,) = contexts(files, source)
    # Breadth first: top-level calls before nested ones, unnamed calls left out.
    assert row["downstream_calls"] == ["first", "c", "outer", "inner"]
    assert row["context_asset_references"] == ["https://a.acme.io", "a.acme.io"]
    assert row["context_asset_kinds"] == ["url", "host"]


def test_scope_is_read_when_no_use_names_an_asset(files):
    source = '''
        class Client:
            url = "https://outer.acme.io"
            def go(self):
                send("KEY", "redis://cache.internal:1")
        other = "https://far.acme.io"
    '''
    (row,) = contexts(files, source)
    assert row["enclosing_function"] == "go" and row["call_name"] == "send"
    assert row["downstream_calls"] == ["send"]
    assert row["context_asset_references"] == ["redis://cache.internal:1", "cache.internal"]


def test_whole_file_is_read_outside_scopes(files):
    (row,) = contexts(files, 'a = "KEY"\nb = "mysql://db.local/x"\n')
    assert row["context_asset_references"] == ["mysql://db.local/x", "db.local"]


def test_multi_line_and_escaped_literals(files):
    source = 'x = """\n\\n text \n KEY\n"""\ny = "café"; use(x, "é http://é.io")\n'
    (row,) = contexts(files, source)
    assert row["variable_name"] == "x" and row["line_number"] == 3
    # The call starts before the candidate's line ends the literal, but after the candidate.
    assert row["downstream_calls"] == ["use"]
    assert row["context_asset_references"] == ["http://é.io"]
    assert row["usage_context"].startswith('x = """')


def test_first_literal_in_parse_order_wins(files):
    rows = contexts(files, 'f("KEY"); x = "KEY"\n')
    # Both candidates are on one line; the shallower literal is met first.
    assert {r["variable_name"] for r in rows} == {"x"}


def test_facts_reach_every_segment(files):
    filler = "# " + "word " * 3000 + "\n"
    source = 'a = "KEY"\n' + filler + 'use(a, "https://x.acme.io")\nb = "' + KEY[::-1] + '"\n' + filler + "late(b)\n"
    first, second = contexts(files, source)
    assert (first["variable_name"], first["downstream_calls"]) == ("a", ["use"])
    assert (second["variable_name"], second["downstream_calls"]) == ("b", ["late"])


def test_a_value_found_elsewhere_in_a_literal_of_its_line(files):
    source = 'x = """KEY\\t\n"""; y = ["KEY", KEY_KEY]  # KEY\n'
    rows = contexts(files, source)
    # All places on the literal's two lines find the literal that holds their value first in parse order.
    assert {r["variable_name"] for r in rows if r["line_number"] == 1} == {"x"}
    assert {r["variable_name"] for r in rows if r["line_number"] == 2} <= {"x", None}


def test_cost_of_one_long_literal_follows_its_size(files):
    """A literal as long as its file goes to each segment with that segment's runs only."""
    from keysieve.operators.python_facts import _holds_run, file_facts, placed_literals

    def carried(lines):
        text = 'NOTES = """' + "".join(f"word {i:05d} {KEY}{i:05d} more\n" * 4 for i in range(lines)) + '"""\n'
        facts = file_facts(text, _holds_run)
        places = placed_literals(text, facts["literals"])
        assert len(places) == 4 * lines
        return sum(len(p["value"]) for p in places) / len(text)

    assert carried(2000) < 1.1 * carried(500) < 1.1
    rows = add_context(recover_candidates(files(("a.py", 'NOTES = """' + f"word {KEY} more\n" * 3000 + '"""\n'))))
    assert rows.where("variable_name = 'NOTES'").count() == 3000


def test_task_functions_need_no_installed_package():
    from pyspark import cloudpickle

    from keysieve.operators import python_facts as P

    for function in (P.file_facts, P.placed_literals, P._holds_run, P._holds_any):
        assert b"keysieve.catalog" not in cloudpickle.dumps(function)


def program(rng, functions, shared):
    """Nested classes and functions with literals, calls before and after them, and assets."""
    out, depth = [], 0
    for i in range(functions):
        if rng.random() < 0.2:
            depth = rng.randrange(3)
            out += ["    " * d + f"class C{i}_{d}:" for d in range(depth)]
        pad = "    " * depth
        name = "token" if rng.random() < shared else f"token_{i}"
        value = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        out += [f"{pad}def work_{i}():", f'{pad}    {name} = "{value}"']
        if rng.random() < 0.7:
            out.append(f"{pad}    {rng.choice(['connect', 'a.send', f'run_{i}'])}({name}, {rng.choice(['1', chr(34) + f'https://h{i % 3}.acme.io' + chr(34)])})")
        if rng.random() < 0.3:
            out.append(f'{pad}    url = "https://scope{i}.acme.io"')
        if rng.random() < 0.2:
            out.append(f'{pad}    pair = ["{value}", "{value[::-1]}"]')
    return "\n".join(out) + "\n"


@pytest.mark.parametrize("chars", [200, 900])
def test_facts_by_segment_say_what_the_whole_file_says(files, chars):
    rng = random.Random(chars)
    sources = [(f"p{i}.py", program(rng, 25, 0.5)) for i in range(6)]
    names = ["file_path", "sig_ord", "start_index", "variable_name", "enclosing_function", "call_name", "downstream_calls",
             "context_asset_references", "context_asset_kinds", "usage_context", "context_evidence"]

    def said(**more):
        rows = add_context(recover_candidates(files(*sources), **more)).select(*names)
        return sorted(map(str, rows.collect()))

    assert said(segment_chars=chars) == said(segment_chars=1 << 20)


@pytest.mark.parametrize("shared", [0.0, 1.0])
def test_facts_grow_with_the_file(shared):
    """Twice the file gives at most about twice the facts, whether its functions share a variable or not."""

    def size(functions):
        text = "".join(
            f'def work_{i}():\n    {"token" if shared else f"token_{i}"} = "{i:040x}"\n    connect({"token" if shared else f"token_{i}"}, {i})\n'
            for i in range(functions)
        )
        facts = P.file_facts(text, P._holds_run)
        out = P.segmented(facts, P.placed_literals(text, facts["literals"]), P.segment_ends(text, 8192))
        return sum(len(s[k]) for s in out["segments"] for k in ("places", "calls", "scopes"))

    small, large = size(1_000), size(4_000)
    assert 3_000 <= small <= 3_200 and large <= 4.2 * small
