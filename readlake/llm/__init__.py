"""Operations of a training-data pipeline over text tables.

Nothing else in the package imports this one; deleting the folder leaves the rest whole.
"""
