"""Small PDF files for tests."""

import zlib


def pdf(pages, compress=True):
    """A file whose pages have the given content streams, a font /F1 and a picture /I."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    objects.append(b"<< /Type /XObject /Subtype /Image /Width 2 /Height 2 /Filter /DCTDecode /Length 4 >>\nstream\nJPEG\nendstream")
    kids = []
    for body in pages:
        raw = body.encode("cp1252")
        data = zlib.compress(raw) if compress else raw
        objects.append(b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if compress else b"") + data + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /I 4 0 R >> >> >>" % len(objects))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n" % i + o + b"\nendobj\n" for i, o in enumerate(objects, 1))
    return out + b"trailer << /Root 1 0 R >>\n"


TWO_PAGES = [
    "BT /F1 20 Tf 50 700 Td (Annual Report) Tj 0 -30 Td /F1 10 Tf (First \\(body\\) line ) Tj (goes on) Tj 0 -14 Td [(Sec) -20 (ond) -300 (line.)] TJ ET q 200 0 0 150 50 100 cm /I Do Q q 20 0 0 15 50 100 cm /I Do Q BT /F1 10 Tf 50 80 Td (Caf\\351 end) Tj ET",
    "BT /F1 12.5 Tf 1 0 0 1 50 700 Tm (Sub head) Tj /F1 10 Tf 14 TL T* (text) Tj T* <48656C6C6F> Tj (more.) ' ET",
]
