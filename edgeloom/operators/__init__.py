"""edgeloom.operators"""
