"""Labels and decisions of the mail formats: methods, kinds, code pages, property types and names, times."""

from __future__ import annotations

import codecs
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill.functions.contained import contained
from postmill.functions.names import has, upper_ascii

#: Attachment methods 0 to 6 and recipient types. Fixed values.
METHODS = ("none", "by_value", "by_reference", "by_reference_resolve", "by_reference_only", "embedded_message", "ole")
RECIPIENTS = {0: "originator", 1: "to", 2: "cc", 3: "bcc"}
#: Flags that a recipient type may carry: 0x10000000 and 0x80000000 cleared from 32 bits. Fixed value.
TYPE_MASK = 0x6FFFFFFF
#: Type codes. Fixed values.
FIXED_TYPES = (2, 3, 4, 5, 6, 7, 10, 11, 20, 64)
MULTI = 0x1000
HEADERS = {"message": 32, "embedded_message": 24, "recipient": 8, "attachment": 8}
#: Code pages: the default, those that hold ASCII as it is, and those of more than one byte a character. Fixed values.
DEFAULT_PAGE = 1252
ASCII_PAGES = (20127, 1252, 28591, 65001)
MULTIBYTE = (932, 936, 949, 950, 51932, 51949, 54936)
#: Code page to Python codec. Fixed values.
CODECS = {
    437: "cp437", 850: "cp850", 852: "cp852", 866: "cp866", 874: "cp874", 932: "cp932", 936: "gbk", 949: "cp949", 950: "cp950", 1250: "cp1250", 1251: "cp1251",
    1252: "cp1252", 1253: "cp1253", 1254: "cp1254", 1255: "cp1255", 1256: "cp1256", 1257: "cp1257", 1258: "cp1258", 20127: "ascii", 20866: "koi8_r", 21866: "koi8_u",
    28591: "latin_1", 28592: "iso8859_2", 28595: "iso8859_5", 28597: "iso8859_7", 28599: "cp1254", 28605: "iso8859_15", 51932: "euc_jp", 51949: "euc_kr", 54936: "gb18030", 65001: "utf_8",
}
#: Property sets by GUID as stored. Fixed values.
PROPERTY_SETS = {
    "2803020000000000C000000000000046": "PS_MAPI", "2903020000000000C000000000000046": "PS_PUBLIC_STRINGS", "0820060000000000C000000000000046": "PSETID_Common",
    "0420060000000000C000000000000046": "PSETID_Address", "8603020000000000C000000000000046": "PS_INTERNET_HEADERS", "0220060000000000C000000000000046": "PSETID_Appointment",
    "90DAD86E0B451B1098DA00AA003F1305": "PSETID_Meeting", "0A20060000000000C000000000000046": "PSETID_Log", "0320060000000000C000000000000046": "PSETID_Task",
}


def method_label(method: Column) -> Column:
    """Label of an attachment method; unknown numbers and missing ones have labels of their own."""
    label = F.when(method.isNull(), "unreadable")
    for k, name in enumerate(METHODS):
        label = label.when(method == k, name)
    return label.otherwise("unrecognized")


def recipient_kind(raw: Column) -> Column:
    """to, cc or bcc once the flags are cleared; null for the originator and unknown types."""
    bare = raw.bitwiseAND(F.lit(TYPE_MASK))
    return F.when(bare == 1, "to").when(bare == 2, "cc").when(bare == 3, "bcc")


def recipient_bucket(raw: Column) -> Column:
    """As the inventory counts types: with their flags."""
    label = F.when(raw.isNull(), "missing")
    for k, name in RECIPIENTS.items():
        label = label.when(raw == k, name)
    return label.otherwise("unrecognized")


def is_originator(raw: Column) -> Column:
    return raw.bitwiseAND(F.lit(TYPE_MASK)) == 0


def page_in_effect(message: Column, internet: Column) -> tuple[Column, Column]:
    """Code page and where it comes from: the message, its Internet page, else the default. Pages of 0 and below are absent."""
    m, i = (F.when(p > 0, p) for p in (message, internet))
    return F.coalesce(m, i, F.lit(DEFAULT_PAGE)), F.when(m.isNotNull(), "message").when(i.isNotNull(), "internet").otherwise("default")


def entry_kind(name: Column, is_root: Column | bool = False) -> Column:
    """Kind of a container entry by its name."""
    root = F.lit(is_root) if isinstance(is_root, bool) else is_root
    return (
        F.when(root, "root")
        .when(name == "__properties_version1.0", "properties_stream")
        .when(name == "__nameid_version1.0", "named_property_storage")
        .when(F.startswith(name, F.lit("__attach_version1.0_#")), "attachment_storage")
        .when(F.startswith(name, F.lit("__recip_version1.0_#")), "recipient_storage")
        .when(name == "__substg1.0_3701000D", "embedded_object_storage")
        .when(has(name, SUBSTG), "property_stream")
        .otherwise("unrecognized")
    )


SUBSTG = r"^__substg1\.0_([0-9A-Fa-f]{4})([0-9A-Fa-f]{4})(-[0-9A-Fa-f]{8})?$"


def stream_property(name: Column) -> tuple[Column, Column, Column]:
    """Property id, type and whether one of several values, of a property stream's name; nulls for other names."""
    number = lambda g: F.when(has(name, SUBSTG), F.conv(F.regexp_extract(name, SUBSTG, g), 16, 10).cast("int"))
    return number(1), number(2), F.when(has(name, SUBSTG), F.regexp_extract(name, SUBSTG, 3) != "")


def name_shape(name: Column) -> Column:
    return F.when(F.startswith(name, F.lit("__substg1.0_")), "malformed_property_stream_name").when(F.startswith(name, F.lit("__")), "other_reserved_name").otherwise("other_name")


def name_mismatch(kind: Column, is_stream: Column) -> Column:
    stream = kind.isin("properties_stream", "property_stream")
    storage = kind.isin("attachment_storage", "recipient_storage", "named_property_storage", "embedded_object_storage")
    return F.when(stream & ~is_stream, "stream_name_is_storage").when(storage & is_stream, "storage_name_is_stream")


#: The last storage of a path, above its last part, that gives a scope, by how its name starts; and the scopes. Fixed values.
SCOPE = r"(?s)^(?:.*/)?(__substg1\.0_3701000D(?=/)|__nameid_version1\.0(?=/)|__recip_version1\.0_#|__attach_version1\.0_#)[^/]*/"
SCOPES = {"__substg1.0_3701000D": "embedded_message", "__nameid_version1.0": "named_properties", "__recip_version1.0_#": "recipient", "__attach_version1.0_#": "attachment", "": "message"}


def scope(path: Column) -> Column:
    """The nearest storage of a path that gives its entries a scope."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in SCOPES.items() for x in pair)), F.regexp_extract(path, SCOPE, 1))


def ancestry(path: Column) -> Column:
    """The storages above an entry as tokens that tell nothing of their names."""

    def token(part):
        return (
            F.when(F.startswith(part, F.lit("__recip_version1.0_#")), "recipient")
            .when(F.startswith(part, F.lit("__attach_version1.0_#")), "attachment")
            .when(part == "__substg1.0_3701000D", "embedded_object")
            .when(part == "__nameid_version1.0", "named_properties")
            .when(F.startswith(part, F.lit("__")), "reserved")
            .otherwise("custom")
        )

    parts = F.split(path, "/")
    return F.array_join(F.concat(F.array(F.lit("root")), F.transform(F.slice(parts, F.lit(2), F.size(parts) - 2), token)), "/")


def type_shape(kind: Column) -> Column:
    """How a property of the type is stored."""
    return F.when(kind.bitwiseAND(F.lit(MULTI)) != 0, "multi_value").when(kind.isin(*FIXED_TYPES), "fixed").otherwise("variable")


def header_length(where: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, n in HEADERS.items():
        out = F.when(where == name, n).otherwise(out)
    return out


def nibbles(n: Column) -> Column:
    """A 64-bit number whose hex digits have changed places in each byte."""
    low = F.lit(0x0F0F0F0F0F0F0F0F)
    return F.shiftleft(n.bitwiseAND(low), 4).bitwiseOR(F.shiftright(n, 4).bitwiseAND(low))


def word(data: Column) -> Column:
    """The little-endian number of up to 8 bytes, signed where it is 8; null for none. Digits are read backwards and then swapped in
    each byte by arithmetic, as cutting a text into bytes costs many times as much."""
    return nibbles(F.conv(F.reverse(F.hex(data)), 16, -10).cast("long"))


def little_endian(data: Column, start: int | Column, size: int) -> Column:
    """Unsigned integer of up to 7 bytes at a position (from 1) of a binary."""
    at = F.lit(start) if isinstance(start, int) else start
    return word(F.substr(data, at, F.lit(size)))


def bits(number: Column, at: int, size: int) -> Column:
    """Unsigned number of some bits of a word, from the least significant on."""
    return F.shiftrightunsigned(number, at).bitwiseAND(F.lit((1 << size) - 1).cast("long"))


def property_entries(data: Column, header: Column) -> Column:
    """Array of the 16-byte entries of a properties stream after its header: type, id, flags, tail (8 bytes); bytes left over are not one."""
    count = F.greatest(F.lit(0), F.floor((F.octet_length(data) - header) / 16).cast("int"))
    at = lambda i: header + i * 16 + 1

    def entry(i):
        return F.struct(
            little_endian(data, at(i), 2).cast("int").alias("property_type"), little_endian(data, at(i) + 2, 2).cast("int").alias("property_id"),
            little_endian(data, at(i) + 4, 4).alias("flags"), F.substr(data, at(i) + 8, F.lit(8)).alias("tail"),
        )

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), entry)).otherwise(F.array().cast("array<struct<property_type:int,property_id:int,flags:bigint,tail:binary>>"))


def signed(number: Column, size: int) -> Column:
    """The lowest bits of a word as a whole number, two's complement."""
    n = bits(number, 0, size)
    return F.when(n >= 1 << (size - 1), n - (1 << size)).otherwise(n)


def real(bits: Column, fraction: int, exponent: int) -> Column:
    """Double that the bits of an IEEE number stand for, given the sizes of its fraction and its exponent."""
    bias, top = (1 << (exponent - 1)) - 1, (1 << exponent) - 1
    e = F.shiftright(bits, fraction).bitwiseAND(F.lit(top))
    m = bits.bitwiseAND(F.lit((1 << fraction) - 1)).cast("double") / float(1 << fraction)
    sign = F.when(F.shiftright(bits, fraction + exponent).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    finite = F.when(e == 0, m * F.pow(F.lit(2.0), F.lit(float(1 - bias)))).otherwise((m + 1.0) * F.pow(F.lit(2.0), (e - bias).cast("double")))
    return F.when(e < top, sign * finite).when(m == 0, sign * F.lit(float("inf"))).otherwise(F.lit(float("nan")))


def fixed_word(kind: Column, number: Column) -> Column:
    """The value of a fixed-length property from the word of its 8 bytes as struct(as_long, as_double): integers, times, errors and truth
    values as long, others as double; null for other types."""
    as_long = F.when(kind == 2, signed(number, 16)).when(kind == 3, signed(number, 32)).when(kind == 10, bits(number, 0, 32)).when(kind == 11, (bits(number, 0, 8) != 0).cast("long")).when(kind.isin(6, 20, 64), number)
    as_double = F.when(kind == 4, real(bits(number, 0, 32), 23, 8)).when(kind.isin(5, 7), real(number, 52, 11))
    return F.struct(as_long.alias("as_long"), as_double.alias("as_double"))


def fixed_value(kind: Column, tail: Column) -> Column:
    """fixed_word of a property's 8 bytes; null for other lengths."""
    return fixed_word(kind, F.when(F.octet_length(tail) == 8, word(tail)))


def valid_boolean(number: Column) -> Column:
    """Whether the word of a property's 8 bytes is a truth value."""
    return number.isin(0, 1)


def stream_path(parent: Column, property_id: Column, kind: Column) -> Column:
    """Where a variable-length property's value must be."""
    code = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    return F.concat(parent, F.lit("/__substg1.0_"), code(property_id), code(kind))


def declared_size(kind: Column, length: Column) -> Column:
    """Size that a property's entry declares for a stream of the length: terminators count."""
    return length + F.when(kind == 31, 2).when(kind == 30, 1).otherwise(0)


def named_entry(raw: Column) -> tuple[Column, Column, Column]:
    """Is-string bit, set index and property index of a named property's second word."""
    return raw.bitwiseAND(F.lit(1)) == 1, F.shiftright(raw, 1).bitwiseAND(F.lit(0x7FFF)), F.shiftright(raw, 16).bitwiseAND(F.lit(0xFFFF))


def set_of_index(index: Column, known: int) -> Column:
    """Kind of set a GUID index means: two fixed ones, then those of the table."""
    return F.when(index == 1, "PS_MAPI").when(index == 2, "PS_PUBLIC_STRINGS").when((index >= 3) & (index < 3 + known), "table").otherwise("out_of_range")


def entry_id(uid: Column, node: Column) -> Column:
    """Hex of 4 zero bytes, the store's 16 bytes and the node number, little-endian."""
    n = F.lpad(F.hex(node.cast("long")), 8, "0")
    return F.lower(F.concat(F.lit("00000000"), uid, *(F.substring(n, p, 2) for p in (7, 5, 3, 1))))


def filetime_text(ticks: Column) -> Column:
    """UTC time of a FILETIME to the second; null before 1601 and after 9999."""
    seconds = F.call_function("div", ticks, F.lit(10_000_000).cast("long"))
    days, rest = F.floor(seconds / 86400).cast("int"), F.pmod(seconds, F.lit(86400))
    day = F.date_format(F.date_add(F.lit("1601-01-01").cast("date"), days), "yyyy-MM-dd")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))
    return F.when((ticks >= 0) & (ticks < 2650467744000000000), text)


def error_label(text: Column) -> Column:
    """What may be told of an error: its kind and a code, nothing that follows."""
    p = r"^([A-Za-z0-9_]+)(?:\(([A-Za-z0-9_-]+)\))?"
    kind, code = F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2)
    return F.when(kind == "", "unknown").when(code == "", kind).otherwise(F.concat(kind, F.lit("_"), code))


def password_outcome(stored: Column, supplied: Column) -> Column:
    """none, verified or refused, by the stored checksum (0: no password) and that of the supplied password."""
    return F.when(F.coalesce(stored, F.lit(0)) == 0, "none").when(supplied == stored, "verified").otherwise("refused")


def password_checksum(password: bytes) -> int:
    """CRC-32 of the polynomial EDB88320 that starts and ends without inversion."""
    return zlib.crc32(password, 0xFFFFFFFF) ^ 0xFFFFFFFF


def decode_counted(data: bytes, page: int) -> tuple[str | None, int, str]:
    """Bytes under a code page: text, how many bytes had no meaning, and text, ascii (page unknown, bytes plain) or unsupported."""
    lost = 0

    def count(e: UnicodeError):
        nonlocal lost
        lost += e.end - e.start
        return "\uFFFD", e.end

    codecs.register_error("postmill-count", count)
    codec = CODECS.get(int(page))
    if codec:
        return bytes(data).decode(codec, "postmill-count"), lost, "text"
    return (bytes(data).decode("ascii"), 0, "ascii") if bytes(data).isascii() else (None, 0, "unsupported")


_decoded = contained(decode_counted, {"text": T.StringType(), "replaced": T.IntegerType(), "status": T.StringType()})


def decoded(data: Column, page: Column) -> Column:
    """struct(text, replaced, status, failed) of bytes under a code page; an unknown page, null too, knows plain ASCII only."""
    return _decoded(data, F.coalesce(page, F.lit(-1)))


def utf16_text(data: Column) -> Column:
    """UTF-16LE bytes as text; an odd last byte is dropped, a surrogate that lacks its other half gives null."""
    even = F.substr(data, F.lit(1), F.octet_length(data) - F.octet_length(data) % 2)
    sound = has(F.hex(even), "^(?:..(?:[0-9A-CEF].|D[0-7])|..D[89AB]..D[C-F])*+$")
    return F.when(sound, F.decode(F.when(sound, even), "UTF-16LE"))


def piece_at(data: Column, offset: Column, size: Column) -> Column:
    """The bytes that follow four bytes of their length, `size`, at an offset (from 0); null where the stream ends before or the length is odd."""
    inside = (offset + 4 <= F.octet_length(data)) & (offset + 4 + size <= F.octet_length(data)) & (size % 2 == 0)
    return F.when(inside, F.substr(data, (offset + 5).cast("int"), F.when(inside, size).otherwise(0).cast("int")))


def string_at(data: Column, offset: Column) -> Column:
    """Text at an offset (from 0) of a stream of strings, each four bytes of its length in bytes and then UTF-16LE; null where the stream
    ends before it, where the length is odd, or where it is no text."""
    return utf16_text(piece_at(data, offset, little_endian(data, (offset + 1).cast("int"), 4)))


def little(value: Column, size: int) -> Column:
    """Hex of a whole number, not negative, in so many bytes, least significant first."""
    return F.reverse(F.lpad(F.hex(nibbles(value.cast("long"))), 2 * size, "0"))


def is_hidden_directory_address(kind: Column, smtp: Column) -> Column:
    """A directory address without an SMTP address."""
    return F.coalesce(upper_ascii(kind) == "EX", F.lit(False)) & smtp.isNull()


def rtf_kind(data: Column) -> Column:
    """encapsulated_html, encapsulated_text, plain_rtf or not_rtf, by the first ten tokens, all of them group starts or control words
    (line breaks between them are none), however long they are."""
    head = F.decode(data, "ISO-8859-1")
    mark = F.regexp_extract(head, r"(?s)^(?:[\r\n]*+(?:\{|\\(?!fromhtml1(?![0-9])|fromtext(?![A-Za-z]))[A-Za-z]++(?:-?[0-9]++)? ?)){0,9}+[\r\n]*+\\(fromhtml1(?![0-9])|fromtext(?![A-Za-z]))", 1)
    return F.when(~F.startswith(head, F.lit("{\\rtf1")), "not_rtf").when(mark == "fromhtml1", "encapsulated_html").when(mark == "fromtext", "encapsulated_text").otherwise("plain_rtf")
