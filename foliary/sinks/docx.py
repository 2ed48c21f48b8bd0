"""A package from paragraphs."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

# fixed values: the least that a package must hold
CONTENT_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
ROOT = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def _runs(text: str) -> str:
    out = []
    for i, line in enumerate(text.split("\n")):
        out.append("<w:br/>" if i else "")
        for j, piece in enumerate(line.split("\t")):
            out.append("<w:tab/>" if j else "")
            out.append(f'<w:t xml:space="preserve">{escape(piece)}</w:t>' if piece else "")
    return f"<w:r>{''.join(out)}</w:r>"


def write_package(texts: list[str]) -> bytes:
    """Deterministic bytes: fixed dates and order."""
    body = "".join(f"<w:p>{_runs(t)}</w:p>" for t in texts)
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:sectPr/></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", ROOT), ("word/document.xml", document)):
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
    return out.getvalue()
