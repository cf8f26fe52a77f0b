"""A plain reading of the patch format, one line at a time, to test against."""

import re

DOT = "[^\n\r\x85\u2028\u2029]"
DIFF = re.compile(f"diff --git a/{DOT}* b/({DOT}*)")
COMMIT = re.compile(f"From[ \t\n\x0b\f\r]([A-Za-z0-9]+)[ \t\n\x0b\f\r]{DOT}*")
OLD = re.compile(f"---[ \t\n\x0b\f\r]a/({DOT}+)[ \t\n\x0b\f\r]?")
NEW = re.compile(f"\\+\\+\\+[ \t\n\x0b\f\r]b/({DOT}+)[ \t\n\x0b\f\r]?")
HEADER = re.compile(f"@@ -([0-9]+),[0-9]+ \\+([0-9]+),[0-9]+ @@{DOT}*")
BODY = re.compile(f"[-+ \t\x0b\f\r]{DOT}*")


def changed_lines(patch, hunk_mode=False, previous=4, following=4, max_length=None):
    lines = patch.split("\n")
    commit = file = None
    numbers = None  # [old, new] once a hunk is open
    position = 0 if hunk_mode else None
    active = hunk_mode
    seen_diff = False
    recent = []
    for at, line in enumerate(lines):
        if m := DIFF.fullmatch(line):
            file, numbers, position, recent = m[1], None, -1, []
            active = seen_diff = True
        elif m := COMMIT.fullmatch(line):
            commit, file, numbers, position = m[1], None, None, None
            active, seen_diff = hunk_mode, False
        elif numbers is None and seen_diff and OLD.fullmatch(line):
            pass
        elif numbers is None and seen_diff and (m := NEW.fullmatch(line)):
            file = m[1]
        elif active and (m := HEADER.fullmatch(line)):
            numbers, recent = [int(m[1]) - 1, int(m[2]) - 1], []
            position += 1
        elif active and numbers is not None and BODY.fullmatch(line):
            recent = (recent + [line[1:]])[-previous:]
            position += 1
            numbers[0] += line[0] != "+"
            numbers[1] += line[0] != "-"
            if line[0] in "+-" and (max_length is None or len(line) <= max_length):
                shown = [
                    x[1:]
                    for x in lines[at : at + following]
                    if BODY.fullmatch(x) and not OLD.fullmatch(x)
                ]
                yield (
                    at, commit, *numbers, position, tuple(recent), line[1:], tuple(shown),
                    file, line[0] == "+",
                )
