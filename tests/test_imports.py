"""Chat exports in every form, against a plain reading of the same JSON."""

import json

from notegrid.sources import files as S

LONG = "said  twice\n\nover"
FORMS = {
    "a": ({"chat_messages": [{"sender": "human", "text": "hi"}, {"sender": "assistant", "text": "", "content": [{"text": "lost"}]}, {"sender": "ai", "content": [{"text": "one"}, "x", {"text": "two"}, {"kind": 1}]}]}, [("user", "hi"), ("assistant", "one two")]),
    "b": ({"messages": [{"role": "user", "content": f" {LONG} "}, "junk", {"role": "assistant", "content": "\t\n"}, {"role": "assistant", "content": "yes", "timestamp": "2024"}]}, [("user", LONG), ("assistant", "yes")]),
    "c": ([{"chat_messages": [{"sender": "human", "text": "1"}]}, {"messages": [{"role": "assistant", "content": "2"}]}, 7, {"other": 1}], [("user", "1"), ("assistant", "2")]),
    "d": ({"mapping": {"x": {"message": {"author": {"role": "assistant"}, "content": {"parts": ["late", None, ""]}, "create_time": 9.5}}, "r": {"message": None}, "a": {"message": {"author": None, "content": {"parts": ["early"]}}}, "n": None}}, [("user", "early"), ("assistant", "late")]),
    "e": ([{"mapping": {"k": {"message": {"author": {"role": "system"}, "content": {"parts": ["s"]}, "create_time": 2}}}}, {"messages": [{"author": {"role": "assistant"}, "content": {"parts": ["p", "q"]}}]}], [("system", "s"), ("assistant", "p q")]),
    "f": ({"messages": [{"author": {"role": "user"}, "content": {"parts": ["deep"]}}, {"role": "assistant", "content": "plain"}, {"role": "", "author": {"role": "system"}, "text": "t"}]}, [("user", "deep"), ("assistant", "plain"), ("system", "t")]),
    "g": ([{"role": "user", "content": "bare"}, {"role": "assistant", "content": "list"}], [("user", "bare"), ("assistant", "list")]),
    "h": ("我：你好\nmore\nDeepSeek: hello\n你: again", [("user", "你好\nmore"), ("assistant", "hello"), ("user", "again")]),
    "i": ('{"broken": ', [("user", '{"broken":')]),
    "j": ({"no": "form"}, [("user", '{"no": "form"}')]),
    "k": (" \n", []),
    "l": ({"chat_messages": []}, []),
    "m": ([], [("user", "[]")]),
}


def test_every_form(spark):
    rows = [(p, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)) for p, (v, _) in FORMS.items()] + [("z.json", None)]
    files = spark.createDataFrame(rows, "path string, value string")
    got = {}
    for r in sorted(S.route(files).collect(), key=lambda r: (r.path, r.turn)):
        got.setdefault(r.path, []).append((r.role, r.content))
    assert got == {p: want for p, (_, want) in FORMS.items() if want}
    assert {r.path: r.format for r in S.detect_format(files).collect()} == dict(zip("abcdefghijklm", ["messages", "messages", "messages", "tree", "tree", "tree", "messages", "transcript", "transcript", "transcript", "empty", "messages", "transcript"], strict=True)) | {"z.json": "empty"}
    big = json.dumps({"messages": [{"role": "user", "content": "x" * 300_000} for _ in range(3)]})
    assert S.route(spark.createDataFrame([("big", big)], "path string, value string")).count() == 3
