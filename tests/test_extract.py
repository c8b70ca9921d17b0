from cairn.sources.extract import SYNTAX_ERROR, parse_text

BROKEN = """def broken(:
    pass

import os

class A(Base):
    def one(self):
        return helper(
    def two(self):
        x = = 3
        return other(x)

def f():
    \"\"\"Says
one thing.\"\"\"
    return os.getcwd()

"""


def test_a_broken_python_file_loses_only_the_broken_blocks():
    text = BROKEN + "".join(f"def bad{i}(:\n    pass\n\ndef good{i}():\n    call{i}()\n\n" for i in range(30)) + "from a import b\n"
    got = parse_text("x.py", text)
    names = {x[6] for x in got["symbols"]}
    assert names >= {"A", "A.two", "f", *(f"good{i}" for i in range(30))} and not any(n.startswith("bad") for n in names)
    assert [x[0] for x in got["imports"]] == ["os", "a"] and ("A", "Base", 6) in got["inheritance"]
    assert {x[1] for x in got["calls"]} >= {"other", "os.getcwd", "call0", "call29"} and got["errors"] == [SYNTAX_ERROR]
    assert next(x[2:5] for x in got["symbols"] if x[0] == "f") == (13, 16, "Says\none thing.")


def test_odd_python_files_end():
    for text in ("   x = (\n  y\n", "def f(", "\0", "x" + "(" * 5000, "'''", "    def g(:\n", "@a\n@b\n", "class A:\n\n\n"):
        assert parse_text("x.py", text)["errors"] == [SYNTAX_ERROR]
    assert [x[0] for x in parse_text("x.py", "def f():\n    return '''\n\ndef g():\n    pass\n")["symbols"]] == ["f", "g"]
