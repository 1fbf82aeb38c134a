"""Fixed values as the oracles state them: SQL text of its own, so that a wrong value in a function shows."""

from __future__ import annotations


#: symbol, its parts
SPLITS = """
    ('eɪ', 'e ɪ'), ('oʊ', 'o ʊ'), ('aɪ', 'a ɪ'), ('aʊ', 'a ʊ'), ('ɔɪ', 'ɔ ɪ'), ('ɪə', 'ɪ ə'), ('ʊə', 'ʊ ə')
"""

#: ARPABET symbol, IPA symbol
ARPABET = """
    ('AA', 'ɑ'), ('AE', 'æ'), ('AH', 'ʌ'), ('AO', 'ɔ'), ('AW', 'aʊ'), ('AY', 'aɪ'), ('B', 'b'), ('CH', 'tʃ'), ('D', 'd'), ('DH', 'ð'), ('EH', 'ɛ'),
    ('ER', 'ɝ'), ('EY', 'eɪ'), ('F', 'f'), ('G', 'ɡ'), ('HH', 'h'), ('IH', 'ɪ'), ('IY', 'i'), ('JH', 'dʒ'), ('K', 'k'), ('L', 'l'), ('M', 'm'),
    ('N', 'n'), ('NG', 'ŋ'), ('OW', 'oʊ'), ('OY', 'ɔɪ'), ('P', 'p'), ('R', 'r'), ('S', 's'), ('SH', 'ʃ'), ('T', 't'), ('TH', 'θ'), ('UH', 'ʊ'),
    ('UW', 'u'), ('V', 'v'), ('W', 'w'), ('Y', 'j'), ('Z', 'z'), ('ZH', 'ʒ')
"""

#: symbol, how the Oxford dictionary writes it
OXFORD = """
    ('tʃ', 'ʧ'), ('dʒ', 'ʤ'), ('i', 'iː'), ('u', 'uː'), ('ɜ', 'ɜː'), ('e', 'eɪ'), ('o', 'oʊ'), ('a', 'aɪ'), ('ɚ', 'ər'), ('ɝ', 'ɜː'), ('n̩', 'n'),
    ('m̩', 'm'), ('l̩', 'l'), ('ˈ', ''), ('ˌ', ''), ('ː', '')
"""

#: vowels that keep their length mark
KEEPS_LENGTH = """
    'i', 'u', 'ɑ', 'ɔ', 'ɜ'
"""

#: replacements of espeak symbols, one after another in this order
ESPEAK = """
    ('tS', 'ʧ'), ('dZ', 'ʤ'), ('N', 'ŋ'), ('T', 'θ'), ('D', 'ð'), ('S', 'ʃ'), ('Z', 'ʒ'), ('x', 'h'), ('?', 'ʔ'), ('J', 'j'), ('@', 'ə'), ('3', 'ɜ'),
    ('A', 'ɑ'), ('I', 'ɪ'), ('O', 'ɔ'), ('U', 'ʊ'), ('e', 'ɛ'), ('o', 'ɒ'), ('a', 'æ'), ('V', 'ʌ'), ('Q', 'ɒ'), ('E', 'ɛ'), ('A:', 'ɑː'),
    ('3:', 'əː'), ('i:', 'iː'), ('O:', 'ɔː'), ('u:', 'uː'), ('aI', 'aɪ'), ('AI', 'aɪ'), ('aj', 'aɪ'), ('eI', 'eɪ'), ('EI', 'eɪ'), ('ej', 'eɪ'),
    ('OI', 'ɔɪ'), ('oj', 'ɔɪ'), ('aU', 'aʊ'), ('AU', 'aʊ'), ('aw', 'aʊ'), ('oU', 'oʊ'), ('OU', 'oʊ'), ('ow', 'oʊ'), ('@U', 'əʊ'), ('I@', 'ɪə'),
    ('e@', 'ɛː'), ('u@', 'ʊə'), ('ɐ', 'æ'), ('ɚ', 'ər'), ('uu', 'u'), ('ii', 'i'), ('oo', 'o'), ('aa', 'a'), ('ee', 'e'), ('r=', 'ər'), ('l=', 'l'),
    ('n=', 'n'), ('m=', 'm'), ('''', ''), (',', ''), (':', '')
"""

#: known symbols
KNOWN = """
    'b', 'ʧ', 'd', 'ð', 'f', 'g', 'h', 'ʤ', 'k', 'l', 'm', 'n', 'ŋ', 'p', 'r', 's', 'ʃ', 't', 'θ', 'v', 'w', 'j', 'z', 'ʒ', 'ɛ', 'ə', 'ɪ', 'i', 'ʊ',
    'ɑ', 'ɔ', 'æ', 'u', 'a', 'ɒ', 'ʌ', 'ɑː', 'ɛː', 'əː', 'iː', 'ɔː', 'uː', 'aʊ', 'eɪ', 'ɔɪ', 'aɪ', 'oʊ', 'ʌɪ', 'əʊ', 'ɪə', 'ʊə'
"""

#: symbols of silence
SILENCE = """
    '', '<sil>', '<spn>', '<unk>'
"""

#: vowel, height, backness, rounding
VOWELS = """
    ('i', 'high', 'front', 'no'), ('ɪ', 'near-high', 'front', 'no'), ('e', 'mid', 'front', 'no'), ('ɛ', 'open-mid', 'front', 'no'),
    ('æ', 'near-open', 'front', 'no'), ('a', 'open', 'front', 'no'), ('ɑ', 'open', 'back', 'no'), ('ɒ', 'open', 'back', 'yes'),
    ('ɔ', 'open-mid', 'back', 'yes'), ('o', 'mid', 'back', 'yes'), ('u', 'high', 'back', 'yes'), ('ʊ', 'near-high', 'back', 'yes'),
    ('ə', 'mid', 'central', 'no'), ('ɜ', 'mid', 'central', 'no'), ('ʌ', 'open-mid', 'central', 'no'), ('ɚ', 'mid', 'central', 'no'),
    ('ɝ', 'mid', 'central', 'no'), ('eɪ', 'mid', 'front', 'no'), ('aɪ', 'open', 'front', 'no'), ('oʊ', 'mid', 'back', 'yes'),
    ('aʊ', 'open', 'back', 'yes'), ('ɔɪ', 'open-mid', 'back', 'yes'), ('ᵻ', 'mid', 'central', 'no')
"""

#: consonant, place, manner, voice
CONSONANTS = """
    ('p', 'bilabial', 'plosive', 'no'), ('b', 'bilabial', 'plosive', 'yes'), ('m', 'bilabial', 'nasal', 'yes'),
    ('f', 'labiodental', 'fricative', 'no'), ('v', 'labiodental', 'fricative', 'yes'), ('w', 'labial-velar', 'approximant', 'yes'),
    ('t', 'alveolar', 'plosive', 'no'), ('d', 'alveolar', 'plosive', 'yes'), ('n', 'alveolar', 'nasal', 'yes'), ('s', 'alveolar', 'fricative', 'no'),
    ('z', 'alveolar', 'fricative', 'yes'), ('l', 'alveolar', 'lateral', 'yes'), ('r', 'alveolar', 'approximant', 'yes'),
    ('ɹ', 'alveolar', 'approximant', 'yes'), ('θ', 'dental', 'fricative', 'no'), ('ð', 'dental', 'fricative', 'yes'),
    ('ʃ', 'postalveolar', 'fricative', 'no'), ('ʒ', 'postalveolar', 'fricative', 'yes'), ('tʃ', 'postalveolar', 'affricate', 'no'),
    ('dʒ', 'postalveolar', 'affricate', 'yes'), ('j', 'palatal', 'approximant', 'yes'), ('k', 'velar', 'plosive', 'no'),
    ('g', 'velar', 'plosive', 'yes'), ('ŋ', 'velar', 'nasal', 'yes'), ('h', 'glottal', 'fricative', 'no')
"""

#: symbol, the symbol whose features it has
SYMBOLS = """
    ('ɝ', 'ɚ'), ('ɛr', 'ɛ'), ('ʊr', 'ʊ'), ('ur', 'u'), ('ər', 'ə')
"""

#: symbol, number of its group of near-equals
ALIASES = """
    ('h', 0), ('∅', 0), ('a', 1), ('ɐ', 1), ('ɑ', 1), ('ə', 1), ('ʌ', 1), ('u', 2), ('uː', 2), ('ər', 2), ('ɚ', 2), ('ɜ', 2), ('ɜː', 2), ('ɝ', 2),
    ('ʊ', 2), ('o', 3), ('oʊ', 3), ('oː', 3), ('ɔ', 3), ('ɔː', 3), ('ə', 3), ('əʊ', 3), ('e', 4), ('eɪ', 4), ('eː', 4), ('ɛ', 4), ('i', 5),
    ('iː', 5), ('ɪ', 5), ('ai', 6), ('aɪ', 6), ('ɑɪ', 6), ('au', 7), ('aʊ', 7), ('ɑʊ', 7), ('b', 8), ('p', 8), ('pʰ', 8), ('d', 9), ('t', 9),
    ('tʰ', 9), ('ɾ', 9), ('g', 10), ('k', 10), ('kʰ', 10), ('b', 11), ('v', 11), ('f', 12), ('p', 12)
"""

#: discourse marker, what it does
DISCOURSE = """
    ('and', 'adding information'), ('but', 'contrasting'), ('however', 'contrasting'), ('therefore', 'concluding'), ('so', 'concluding'),
    ('first', 'sequencing'), ('then', 'sequencing'), ('next', 'sequencing'), ('finally', 'concluding'), ('also', 'adding information'),
    ('furthermore', 'adding information'), ('moreover', 'adding information')
"""

#: advanced words
ADVANCED = """
    'consequently', 'furthermore', 'nevertheless', 'moreover', 'specifically', 'particularly', 'significantly', 'considerably', 'effectively',
    'substantially', 'demonstrate', 'establish', 'determine', 'implement', 'emphasize'
"""

#: marks of subordinate clauses
COMPLEX = """
    ' which ', ' that ', ' although ', ' because ', ' since ', ' while ', ' if ', ' unless ', ' whereas ', ' provided that ', ' in order to '
"""

#: connectors
CONNECTORS = """
    'first', 'second', 'finally', 'however', 'moreover', 'therefore', 'in addition', 'for example', 'such as', 'in conclusion', 'overall'
"""

#: white space, and a word of letters and digits
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
TOKEN = r"[A-Za-z0-9]+''?[A-Za-z0-9]*"

#: letters, the ARPABET symbols of their sounds with vowels unstressed; g has a sound that ARPABET's table does not know
LETTERS = """
    ('igh', 'AY0'), ('tch', 'CH'), ('sh', 'SH'), ('ch', 'CH'), ('th', 'TH'), ('ph', 'F'), ('ng', 'NG'), ('ee', 'IY0'), ('ea', 'IY0'), ('oo', 'UW0'), ('ou', 'AW0'),
    ('ow', 'OW0'), ('ai', 'EY0'), ('ay', 'EY0'), ('oi', 'OY0'), ('oy', 'OY0'), ('ck', 'K'), ('qu', 'K W'), ('wh', 'W'), ('a', 'AE0'), ('b', 'B'), ('c', 'K'), ('d', 'D'),
    ('e', 'EH0'), ('f', 'F'), ('h', 'HH'), ('i', 'IH0'), ('j', 'JH'), ('k', 'K'), ('l', 'L'), ('m', 'M'), ('n', 'N'), ('o', 'AA0'), ('p', 'P'), ('r', 'R'), ('s', 'S'),
    ('t', 'T'), ('u', 'AH0'), ('v', 'V'), ('w', 'W'), ('x', 'K S'), ('y', 'Y'), ('z', 'Z')
"""
