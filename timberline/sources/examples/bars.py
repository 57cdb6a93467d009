"""error|617|disk full"""

name = "bars"


def parse(line):
    level, bar, rest = line.partition("|")
    number, second, msg = rest.partition("|")
    return {"ok": bool(bar and second) and number.isdigit(), "level": level, "msg": msg, "attrs": {"number": int(number) if number.isdigit() else 0}}
