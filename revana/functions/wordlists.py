"""Default stop words for the four languages of the test texts.

Pass your own list (``sources.stopwords``) for anything else.
"""

# Fixed values.
ENGLISH = ("a an and are as at be been but by for from had has have he her his i in is it its "
           "not of on or she that the their they this to was we were which will with you").split()
FRENCH = ("au aux ce ces dans de des du elle en est et il la le les leur mais ne nous ou par pas "
          "pour que qui sa se ses son sur un une vous").split()
GERMAN = ("als am auch auf aus bei das dem den der die ein eine einem einen einer es für ich im "
          "ist mit nach nicht noch sich sie sind und von war wie wir zu zum zur").split()
SPANISH = ("al como con del el ella ellos entre era es esta este fue ha hay las lo los más me mi "
           "muy no nos o para pero por se sin sobre su sus también te tu un una y ya").split()

DEFAULT = sorted(set(ENGLISH + FRENCH + GERMAN + SPANISH))
