"""Test tables read as publications, and the plans that queries share."""
