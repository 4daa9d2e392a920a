"""Markdown to HTML: headings, paragraphs, nested lists, quotes, fenced and indented code, tables, rules and inline marks."""

from __future__ import annotations

import re
from html import escape

_FENCE = re.compile(r"^ {0,3}(```+|~~~+)\s*([\w+-]*)\s*$")
_ATX = re.compile(r"^(#{1,6})[ \t]*(.*?)[ \t]*#*[ \t]*$")
_SETEXT = re.compile(r"^(=+|-+)[ \t]*$")
_RULE = re.compile(r"^ {0,3}((\*[ \t]*){3,}|(-[ \t]*){3,}|(_[ \t]*){3,})$")
_ITEM = re.compile(r"^( *)([*+-]|\d+[.)])[ \t]+(.*)$")
_DASHES = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_BLOCK_TAG = re.compile(r"^<(/?(?:address|article|aside|blockquote|body|details|div|dl|fieldset|footer|form|h[1-6]|head|header|hr|html|iframe|main|nav|ol|p|pre|script|section|style|table|ul)\b|!--)", re.I)
_CODE = re.compile(r"(`+)(.+?)(?<!`)\1(?!`)", re.S)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<!--.*?-->", re.S)
_IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^\s)>]*)>?(?:\s+\"([^\"]*)\")?\s*\)")
_LINK = re.compile(r"\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^\s)>]*)>?(?:\s+\"([^\"]*)\")?\s*\)")
_AUTO = re.compile(r"<((?:https?|ftp|mailto):[^\s<>]+)>")
_STRONG = re.compile(r"(\*\*|__)(?=\S)(.+?[*_]*)(?<=\S)\1", re.S)
_EM = re.compile(r"(\*|(?<!\w)_)(?=\S)(.+?)(?<=\S)(?:(?<=[^*])\*(?!\*)|_(?!\w))", re.S)
_ESCAPED = re.compile(r"\\([\\`*_{}\[\]()#+\-.!|>~])")


def inline(text: str) -> str:
    """Inline marks; what is code, a tag or escaped is put aside first, so nothing in it is a mark."""
    kept: list[str] = []

    def keep(s: str) -> str:
        kept.append(s)
        return f"\0{len(kept) - 1}\0"

    def attributes(found) -> str:
        return f' title="{escape(found[3])}"' if found[3] else ""

    text = text.replace("\0", "")
    text = _CODE.sub(lambda m: keep(f"<code>{escape(m[2].strip(), quote=False)}</code>"), text)
    text = _ESCAPED.sub(lambda m: keep(escape(m[1], quote=False)), text)
    text = _AUTO.sub(lambda m: keep(f'<a href="{escape(m[1])}">{escape(m[1], quote=False)}</a>'), text)
    text = _IMAGE.sub(lambda m: keep(f'<img src="{escape(m[2])}" alt="{escape(m[1])}"{attributes(m)}>'), text)
    text = _LINK.sub(lambda m: keep(f'<a href="{escape(m[2])}"{attributes(m)}>') + m[1] + keep("</a>"), text)
    text = _TAG.sub(lambda m: keep(m[0]), text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;")
    text = _STRONG.sub(r"<strong>\2</strong>", text)
    text = _EM.sub(r"<em>\2</em>", text)
    text = re.sub(r" {2,}\n", "<br>\n", text)
    while (whole := re.sub(r"\0(\d+)\0", lambda m: kept[int(m[1])], text)) != text:
        text = whole
    return text


def _cells(line: str) -> list[str]:
    line = line.strip().removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip() for c in re.split(r"(?<!\\)\|", line)]


def _table(head: str, rows: list[str]) -> str:
    names = _cells(head)
    row = lambda cells, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in (cells + [""] * len(names))[: len(names)]) + "</tr>"
    return "<table><thead>" + row(names, "th") + "</thead><tbody>" + "".join(row(_cells(r), "td") for r in rows) + "</tbody></table>"


def _list(lines: list[str]) -> tuple[str, int]:
    """A list at the lines' beginning, and how many lines it takes."""
    first = _ITEM.match(lines[0])
    indent, ordered = len(first[1]), first[2][0].isdigit()
    items: list[list[str]] = []
    loose = False
    i = 0
    while i < len(lines):
        line = lines[i]
        found = _ITEM.match(line)
        if found and len(found[1]) <= indent + 1:
            if len(found[1]) < indent or found[2][0].isdigit() != ordered:
                break
            items.append([found[3]])
        elif not line.strip():
            behind = next((x for x in lines[i + 1 :] if x.strip()), None)
            if behind is None or not (behind.startswith(" " * (indent + 2)) or ((m := _ITEM.match(behind)) and len(m[1]) >= indent and m[2][0].isdigit() == ordered)):
                break
            items[-1].append("")
            loose = True
        elif line.startswith(" " * (indent + 2)) or line.startswith("\t"):
            items[-1].append(re.sub(rf"^(\t| {{1,{indent + 4}}})", "", line))
        elif found or _ATX.match(line) or _FENCE.match(line):
            break
        else:
            items[-1].append(line.strip())
        i += 1
    tag = "ol" if ordered else "ul"
    made = []
    for item in items:
        html = convert("\n".join(item), in_item=True)
        made.append("<li>" + (html if loose else re.sub(r"\A<p>(.*?)</p>", r"\1", html, count=1, flags=re.S)) + "</li>")
    return f"<{tag}>\n" + "\n".join(made) + f"\n</{tag}>", i


def convert(text: str, in_item: bool = False) -> str:
    """HTML of a Markdown text; HTML blocks in it stay as they are. In a list's item a list may begin right behind a line."""
    lines = text.replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    out: list[str] = []
    held: list[str] = []

    def close():
        if held:
            out.append("<p>" + inline("\n".join(x.strip() if not x.endswith("  ") else x.lstrip() for x in held).strip()) + "</p>")
            held.clear()

    i = 0
    while i < len(lines):
        line = lines[i]
        if fence := _FENCE.match(line):
            close()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(fence[1]) and not lines[j].strip().strip(fence[1][0])), len(lines))
            out.append("<pre><code>" + escape("\n".join(lines[i + 1 : end]), quote=False) + "\n</code></pre>")
            i = end + 1
        elif not line.strip():
            close()
            i += 1
        elif (header := _ATX.match(line)) and header[2]:
            close()
            level = len(header[1])
            out.append(f"<h{level}>{inline(header[2])}</h{level}>")
            i += 1
        elif held and (under := _SETEXT.match(line)):
            title = held.pop()
            close()
            level = 1 if under[1][0] == "=" else 2
            out.append(f"<h{level}>{inline(title.strip())}</h{level}>")
            i += 1
        elif _RULE.match(line):
            close()
            out.append("<hr>")
            i += 1
        elif "|" in line and i + 1 < len(lines) and "|" in lines[i + 1] and _DASHES.match(lines[i + 1]):
            close()
            end = next((j for j in range(i + 2, len(lines)) if "|" not in lines[j] or not lines[j].strip()), len(lines))
            out.append(_table(line, lines[i + 2 : end]))
            i = end
        elif line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            close()
            end = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            out.append("<blockquote>\n" + convert("\n".join(re.sub(r"^ {0,3}> ?", "", x) for x in lines[i:end])) + "\n</blockquote>")
            i = end
        elif (item := _ITEM.match(line)) and len(item[1]) < 4 and (not held or in_item):
            close()
            html, n = _list(lines[i:])
            out.append(html)
            i += n
        elif not held and line.startswith("    "):
            end = next((j for j in range(i, len(lines)) if lines[j].strip() and not lines[j].startswith("    ")), len(lines))
            out.append("<pre><code>" + escape("\n".join(x[4:] for x in lines[i:end]).rstrip(), quote=False) + "\n</code></pre>")
            i = end
        elif not held and _BLOCK_TAG.match(line):
            end = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            out.append("\n".join(lines[i:end]))
            i = end
        else:
            held.append(line)
            i += 1
    close()
    return "\n\n".join(out)
