"""Small score documents, written for the tests."""

HEAD = """<meiHead><fileDesc><titleStmt><title> {title} </title><respStmt>
<persName role="composer">Doe, Ann</persName><persName role="mei_editor">E. One</persName>
<persName role="MEI_editor">E. Two</persName><persName role="analyst">A. Nalyst</persName></respStmt></titleStmt>
<pubStmt><date isodate="2024-02-29"/><availability>free</availability></pubStmt></fileDesc>
<encodingDesc><appInfo><application><name>Pen</name></application></appInfo></encodingDesc>
<workList><work><title>The Work</title></work></workList></meiHead>"""


def score(body: str, definition: str = '<scoreDef ppq="480"/>', title: str = "A Piece") -> str:
    return (
        '<?xml version="1.0"?><mei xmlns="http://www.music-encoding.org/ns/mei">'
        f"{HEAD.format(title=title)}<music><body><mdiv><score>{definition}{body}</score></mdiv></body></music></mei>"
    )


def measure(n: int, *layers: str, attrs: str = "", extra: str = "") -> str:
    staves = "".join(f'<staff n="{i}"><layer n="1">{layer}</layer></staff>' for i, layer in enumerate(layers, 1))
    return f'<measure n="{n}" {attrs}>{staves}{extra}</measure>'


def note(name: str, dur: int | None = None, id: str = "", attrs: str = "", child: str = "") -> str:
    """note("c#4", 480): a note with stated ticks."""
    step, accid, octave = name[0], name[1:-1], name[-1]
    sharp = {"": "", "#": 'accid="s"', "-": 'accid="f"'}[accid]
    ticks = "" if dur is None else f'dur.ppq="{dur}"'
    xml_id = f'xml:id="{id}"' if id else ""
    return f'<note {xml_id} pname="{step}" oct="{octave}" {sharp} {ticks} {attrs}>{child}</note>'


def rest(dur: int) -> str:
    return f'<rest dur.ppq="{dur}"/>'


def line(text: str, prefix: str) -> str:
    """line("c4:480 -:240", "a"): notes and rests with ids a1, a2, ..."""
    out = []
    for k, item in enumerate(text.split(), 1):
        name, ticks = item.split(":")
        out.append(rest(int(ticks)) if name == "-" else note(name, int(ticks), f"{prefix}{k}"))
    return "".join(out)
