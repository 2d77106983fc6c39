"""Metadata of wiki sites: from the matrix of all sites, from a site's own answer, from a dump's head, or from its name."""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET

#: Endings of database names, the project each stands for and what its pages are.
PROJECTS = {
    "wiki": ("Wikipedia", "encyclopedia articles"),
    "wiktionary": ("Wiktionary", "dictionary entries"),
    "wikibooks": ("Wikibooks", "textbooks"),
    "wikinews": ("Wikinews", "news articles"),
    "wikiquote": ("Wikiquote", "quotations"),
    "wikisource": ("Wikisource", "source texts"),
    "wikiversity": ("Wikiversity", "learning resources"),
    "wikivoyage": ("Wikivoyage", "travel guides"),
}
FIELDS = ("name", "project", "language", "language_name", "url", "closed")


def project_of(name: str) -> tuple[str, str, str]:
    """(language, project, what its pages are) by a database name; the longest ending counts."""
    for end in sorted(PROJECTS, key=len, reverse=True):
        if name.endswith(end) and name != end:
            return name.removesuffix(end).replace("_", "-"), *PROJECTS[end]
    return "", name, "pages"


def inferred(name: str) -> dict:
    language, project, _ = project_of(name)
    return {"name": f"{language} {project}".strip(), "project": project, "language": language, "language_name": language, "url": "", "closed": False}


def matrix_of(answer: bytes | str) -> dict[str, dict]:
    """Sites by database name from the matrix: languages with their sites, and special ones."""
    out = {}
    for key, group in json.loads(answer)["sitematrix"].items():
        if key == "count":
            continue
        sites = group if key == "specials" else group.get("site", [])
        for s in sites:
            code = s.get("lang", "") if key == "specials" else group.get("code", "")
            language = "" if key == "specials" else group.get("localname") or group.get("name") or code
            _, project, _ = project_of(s["dbname"])
            title = s.get("sitename", "")
            # a project's bare name says nothing without its language
            name = f"{language} {title}".strip() if title in {p for p, _ in PROJECTS.values()} else title
            out[s["dbname"]] = {"name": name, "project": project, "language": code, "language_name": language, "url": s.get("url", ""), "closed": "closed" in s}
    return out


def site_info(answer: bytes | str) -> dict:
    """A site's own answer about itself."""
    general = json.loads(answer)["query"]["general"]
    return {"name": general.get("sitename", ""), "language": general.get("lang", ""), "url": general.get("server", ""), "project": project_of(general.get("wikiid", ""))[1] if general.get("wikiid") else ""}


def dump_head(xml: bytes) -> dict:
    """What the head of an export says about its site; the bytes may end anywhere after it."""
    end = xml.find(b"</siteinfo>")
    if end < 0:
        return {}
    begin = xml.find(b"<siteinfo")
    node = ET.fromstring(re.sub(rb"^<siteinfo[^>]*>", b"<siteinfo>", xml[begin : end + len(b"</siteinfo>")]))
    name = node.findtext("dbname") or ""
    base = node.findtext("base") or ""
    return {"name": node.findtext("sitename") or "", "language": project_of(name)[0], "project": project_of(name)[1], "url": re.sub(r"/wiki/.*$", "", base)}


def merged(*sources: dict) -> dict:
    """Each field from the first source that has it."""
    return {f: next((s[f] for s in sources if s.get(f)), False if f == "closed" else "") for f in FIELDS}


def description(site: dict) -> str:
    kind = next((k for p, k in PROJECTS.values() if p == site["project"]), "pages")
    said = f"{site['name'] or site['project']}: {kind}" + (f" in {site['language_name']}" if site["language_name"] else "")
    return said + (" (closed)" if site.get("closed") else "")
