"""edgeloom.functions"""
